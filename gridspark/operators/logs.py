"""Run logs: mass lines, failures and stability records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.sources.text import NUMBER

def phrase(*parts: str, gap: str = r"\s+") -> str:
    """A pattern for printed words in any case, `gap` between the words of a part, fields in parentheses as given."""
    text = [p if p.startswith("(") else gap.join(map(re.escape, p.split())) for p in parts]
    return "(?i)" + r"\s*".join(text)


FIELD, WHOLE = f"({NUMBER})", r"(\d+)"
MASS = phrase("time t", "=", FIELD, ",", "total mass", "=", FIELD, "diff", "=", FIELD)

# Texts that mean a run failed, first match wins (fixed values).
FAILURES = (
    "SOLUTION ERROR",
    "Error ***",
    "Too many dt reductions",
    "Stopping calculation",
    "set_fgout: ERROR",
    "ERROR reading hydraulic",
    "ERROR: hydraulic boundary",
    "ERROR: total-discharge boundary",
)

# Stability records: accepted steps over the limit, rejected trials, largest number seen. Marks are counted also when
# wrapped over lines and whatever is printed for the number (asterisks, Infinity, NaN, nothing); details are taken from
# records whose wording stands on one line.
OVER_MARK = phrase("Courant number", "=", r"(\S*)", "is larger than input cfl_max")
OVER = phrase("Courant number", "=", FIELD, "is larger than input cfl_max", "=", FIELD, "on grid", WHOLE, "level", WHOLE, gap=" ")
REJECTED_MARK = phrase("rejected CFL trial")
REJECTED = phrase("rejected CFL trial level", WHOLE, "CFL", "=", FIELD)
SEEN = phrase("maximum Courant number seen", "=", FIELD, gap=" ")


def number(text: Column) -> Column:
    """A printed number as DOUBLE, D exponents included; NULL if it is none."""
    return F.regexp_replace(text, "[dD]", "E").try_cast("double")


def parse_mass_lines(log: DataFrame) -> DataFrame:
    """Every mass record of the texts: (keys, pos, t, volume, diff); a text may be a line or a whole file."""
    keys = [c for c in log.columns if c != "text"]
    found = [F.regexp_extract_all("text", F.lit(MASS), F.lit(g)) for g in (1, 2, 3)]
    rows = F.arrays_zip(*[f.alias(n) for f, n in zip(found, ("t", "volume", "diff"))])
    out = log.select(*keys, F.posexplode(rows).alias("pos", "_r"))
    return out.select(*keys, "pos", *[number(F.col(f"_r.{n}")).alias(n) for n in ("t", "volume", "diff")])


def fatal_reason(text: str | Column) -> Column:
    """The first failure text, by list order, that occurs; NULL for none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in FAILURES])


def _marks(log: DataFrame, pattern: str) -> DataFrame:
    """Occurrences per run: the larger count of the two sources for each whitespace-normalised text, added up."""
    found = log.select("run", "source", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("mark"))
    found = found.withColumn("mark", F.trim(F.regexp_replace("mark", r"\s+", " ")))
    per = found.groupBy("run", "mark", "source").agg(F.count("*").alias("n")).groupBy("run", "mark").agg(F.max("n").alias("n"))
    return per.groupBy("run").agg(F.sum("n").alias("n"))


def log_diagnostics(log: DataFrame) -> DataFrame:
    """Stability summary per run from texts (run, source, part, text).

    `source` is 'log' or 'amr'; records echoed in both count once. `part` orders the
    texts of a source.
    """
    runs = log.select("run").distinct()
    over = _marks(log, OVER_MARK).withColumnRenamed("n", "violations")
    rejected = _marks(log, REJECTED_MARK).withColumnRenamed("n", "rejections")

    def details(pattern: str, groups: dict[str, int]) -> DataFrame:
        cols = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()]
        at = F.when(F.col("source") == "log", 0).otherwise(1)
        return log.select("run", at.alias("_s"), "part", F.posexplode(F.arrays_zip(*cols)).alias("_pos", "_r")).select(
            "run", "_s", "part", "_pos", *[number(F.col(f"_r.{n}")).alias(n) for n in groups]
        )

    o = details(OVER, {"courant": 1, "limit": 2, "grid": 3, "level": 4}).groupBy("run").agg(
        F.max("courant").alias("max_violating"), F.min(F.struct("_s", "part", "_pos", "courant", "grid", "level")).alias("_f")
    ).select("run", "max_violating", F.col("_f.courant").alias("first_courant"), F.col("_f.grid").cast("int").alias("first_grid"), F.col("_f.level").cast("int").alias("first_level"))
    r = details(REJECTED, {"level": 1, "courant": 2}).groupBy("run").agg(F.max("courant").alias("max_rejected"))
    seen = log.where("source = 'amr'").select("run", F.explode(F.regexp_extract_all("text", F.lit(SEEN), F.lit(1))).alias("_v"))
    m = seen.groupBy("run").agg(F.max(number(F.col("_v"))).alias("max_courant"))
    out = runs.join(over, "run", "left").join(rejected, "run", "left").join(o, "run", "left").join(r, "run", "left").join(m, "run", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("violations", "rejections")})
