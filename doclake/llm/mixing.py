"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic); a cell's mass is its number of tokens. Raking multiplies factors of
sources, languages and topics until the weighted masses meet all three target marginals. Each document is then drawn with
the calibrated probability weight / unit, so that expected token shares meet the targets. The unit is the largest weight,
and nothing is repeated, if that keeps the share KEPT of the tokens or more; otherwise it is the one that keeps KEPT, so
that a rare category does not set the scale for all others. ``probability`` is then above 1 for some cells: an expected
number of copies, drawn as its whole part plus a draw by its fraction.
The draw is a hash of id and seed: the same at every run, whatever task or executor makes it.

Cells are aggregated, partially first, so a source with a third of all rows is no hot key; raking is joins and sums over the
table of cells, which has one row for each combination that occurs.

Default targets temper the corpus: a category's target share is its token share to a power, normalised. With power 1 a
marginal keeps its share, with smaller powers the large give to the small. A topic is a rule of the text's own form.
NULL source, language and text count as ``unknown`` and as empty; texts without tokens have no mass and are drawn with the
probability of their cell. Repeated rows share one fate; a row without an id is drawn as if its id were -1. An empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import stored

DIMENSIONS = ("source", "lang", "topic")
#: Powers that temper token shares to target shares.
POWERS = {"source": 0.7, "lang": 0.9, "topic": 1.0}
#: Raking ends when every weighted share is within TOLERANCE of its target, relatively, or when a sweep lessens the largest
#: error by less than this share of it: targets that contradict each other leave an error, which is returned.
TOLERANCE, LEAST_GAIN = 1e-4, 1e-3
#: Share of the tokens (of cells with a target) that is drawn at least, in expectation.
KEPT = 0.5
SEED = 11

log = logging.getLogger(__name__)


def n_tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def topic_of(text: Column) -> Column:
    """Form of a text: tabular (a bar among at most 200 characters), symbolic, numeric, or prose."""
    t = F.coalesce(text, F.lit(""))
    size = F.greatest(F.char_length(t), F.lit(1))

    def share(chars: str) -> Column:
        left = t
        for c in chars:
            left = F.replace(left, F.lit(c), F.lit(""))
        return (F.char_length(t) - F.char_length(left)) / size

    return (
        F.when(share("|") >= 0.005, F.lit("tabular"))
        .when(share("#$%&*") >= 0.05, F.lit("symbolic"))
        .when(share("0123456789") >= 0.05, F.lit("numeric"))
        .otherwise(F.lit("prose"))
    )


def uniform(id_col: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(id_col, F.lit(-1)), F.lit(seed)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def copies(id_col: Column, probability: Column, seed: int = SEED) -> Column:
    """Whole part of ``probability``, and one more with its fraction."""
    whole = F.floor(probability)
    return (whole + (uniform(id_col, seed) < probability - whole).cast("long")).cast("int")


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, topic and n_tokens of every row."""
    text = F.col(text_col).cast("string")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        known("source").alias("source"),
        known("lang").alias("lang"),
        topic_of(text).alias("topic"),
        n_tokens(text).alias("n_tokens"),
    )


def cells_of(rows: DataFrame) -> DataFrame:
    """Mass of every combination that has any."""
    mass = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("mass"))
    return mass.where("mass > 0")


def tempered_targets(cells: DataFrame, powers: dict[str, float] = POWERS) -> dict[str, DataFrame]:
    """For each dimension its categories with target shares."""
    out = {}
    for d in DIMENSIONS:
        raised = cells.groupBy(d).agg(F.pow(F.sum("mass"), F.lit(powers[d])).alias("raised"))
        total = raised.agg(F.sum("raised")).first()[0] or 1.0
        out[d] = raised.select(d, (F.col("raised") / total).alias("target"))
    return out


def remaining_errors(state: DataFrame, targets: dict[str, DataFrame]) -> dict[str, float]:
    """For each dimension the largest relative difference of a weighted share from its target; one job for all of them."""
    parts = None
    for d in DIMENSIONS:
        now = state.groupBy(d).agg(F.sum(F.col("mass") * F.col("weight")).alias("now")).join(targets[d], d)
        off = now.where("target > 0").select(F.lit(d).alias("dimension"), F.abs(F.col("now") / F.col("target") - 1).alias("off"))
        parts = off if parts is None else parts.unionByName(off)
    found = {r["dimension"]: r["off"] for r in parts.groupBy("dimension").agg(F.max("off").alias("off")).collect()}
    return {d: found.get(d) or 0.0 for d in DIMENSIONS}


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE
) -> tuple[DataFrame, dict[str, float]]:
    """Cells with ``weight`` such that the shares of mass * weight meet the targets, and the errors that remain.

    Categories without a target get none of the weight. If targets contradict each other or the cells that occur, the result
    of the last sweep is the closest that raking comes.
    """
    state, before = cells.withColumn("weight", F.lit(1.0)), float("inf")
    while True:
        for d in DIMENSIONS:
            now = state.groupBy(d).agg(F.sum(F.col("mass") * F.col("weight")).alias("now"))
            factor = now.join(targets[d], d, "left").select(
                d, F.when(F.col("now") > 0, F.coalesce("target", F.lit(0.0)) / F.col("now")).otherwise(0.0).alias("f")
            )
            state = state.join(factor, d).withColumn("weight", F.col("weight") * F.col("f")).drop("f")
        # One written table a sweep: plans stay short, and a lost executor costs one sweep.
        state = stored(state.select(*cells.columns, "weight"), "raking")
        errors = remaining_errors(state, targets)
        worst = max(errors.values())
        if worst <= tolerance or worst > before * (1 - LEAST_GAIN):
            return state, errors
        before = worst


def fitted(
    rows: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, DataFrame] | None = None
) -> DataFrame:
    """For each cell of ``rows`` (see ``features``) its mass, weight and expected copies of a document (``probability``).

    ``off_source``, ``off_lang`` and ``off_topic`` hold the largest relative error of that dimension's shares that raking left.
    """
    cells = stored(cells_of(rows), "mixing-cells")
    wanted = targets or {d: stored(t, "mixing-targets") for d, t in tempered_targets(cells, powers).items()}
    raked, errors = rake(cells, wanted)
    there = F.sum(F.when(F.col("weight") > 0, F.col("mass")))
    top, drawn, there = raked.agg(F.max("weight"), F.sum(F.col("mass") * F.col("weight")), there).first()
    unit = min(top, drawn / (KEPT * there)) if there else 1.0
    off = [F.lit(error).alias(f"off_{d}") for d, error in errors.items()]
    out = raked.select(*DIMENSIONS, "mass", "weight", (F.col("weight") / F.lit(unit)).alias("probability"), *off)
    if max(errors.values()) > TOLERANCE:
        log.warning("mixing leaves relative errors of %s", errors)
    log.info("mixing draws %.4f of the tokens, at most %.2f copies of a document", kept_share(out), (top or 0.0) / unit)
    return out


def kept_share(cells: DataFrame) -> float:
    """Expected share of the tokens that is drawn from cells of ``fitted``, copies included."""
    return cells.agg(F.sum(F.col("mass") * F.col("probability")) / F.sum("mass")).first()[0] or 0.0


def _drawn(rows: DataFrame, cells: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Rows with weight, probability, copies and kept. A combination without any token has no weight to fit; its rows stay.

    Catalyst broadcasts the written table of cells if its size allows, and otherwise AQE splits the rows of a hot cell.
    """
    joined = rows.join(cells, list(DIMENSIONS), "left")
    probability = F.coalesce("probability", F.lit(1.0))
    drawn = joined.withColumns({"probability": probability, "copies": copies(F.col(id_col).cast("long"), probability, seed)})
    return drawn.withColumn("kept", F.col("copies") > 0)


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    powers: dict[str, float] = POWERS,
    targets: dict[str, DataFrame] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight (NULL for a cell without tokens), probability, kept and copies of every row.

    The errors that raking left come along (see ``fitted``).
    """
    rows = stored(features(df, id_col, text_col), "mixing-rows")
    drawn = _drawn(rows, fitted(rows, powers, targets), "doc_id", seed)
    off = [f"off_{d}" for d in DIMENSIONS]
    return drawn.select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", "kept", "copies", *off)


def mixed_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    powers: dict[str, float] = POWERS,
    targets: dict[str, DataFrame] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """The rows of ``df`` that are drawn, each as often as it is, with all of their columns. Texts are not shuffled."""
    cells = fitted(features(df, id_col, text_col), powers, targets)
    cells = cells.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.col("probability").alias("_probability"))
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    keys = {"_source": known("source"), "_lang": known("lang"), "_topic": topic_of(F.col(text_col).cast("string"))}
    rows = df.select(F.struct(*df.columns).alias("_row"), *[value.alias(name) for name, value in keys.items()])
    joined = rows.join(cells, list(keys), "left")
    times = copies(F.col("_row")[id_col].cast("long"), F.coalesce("_probability", F.lit(1.0)), seed)
    drawn = joined.withColumn("_copies", times).where("_copies > 0")
    return drawn.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select("_row.*")
