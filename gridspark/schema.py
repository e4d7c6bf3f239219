"""Keys and constants shared by sources, operators and sinks.

A grid is a long table with one row per cell: `i` grows eastward, `j` northward,
both from zero; `x`, `y` are cell centres; NULL means no data.
"""

# Columns that name one field among many; operators group by those present.
GRID_KEYS = ("case", "model", "run", "frame")

# Physical constants and thresholds of the field definitions (fixed values).
GRAVITY = 9.81
WET_DEPTH = 1e-3
VELOCITY_DEPTH = 0.05
LAKE_WET_DEPTH = 1e-4
SUPPORT_DEPTH = 0.01
DEFAULT_DENSITY = 300.0
