from gridspark.functions.keys import grain
from gridspark.functions.ordered import running, shifted
from gridspark.functions.tiles import Geometry, halo_tiles

__all__ = ["Geometry", "grain", "halo_tiles", "running", "shifted"]
