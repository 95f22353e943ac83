"""Fields of benchmark records: outcomes, keys, ground truth, evidence and answers, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .divergence import validated

# Parts of a message or an error's type that tell of memory.
OUT_OF_MEMORY = (
    "out of memory",
    "cuda out of memory",
    "cublas",
    "cudnn",
    "cuda error",
    "memoryerror",
    "std::bad_alloc",
    "cannot allocate memory",
    "allocation failed",
    "alloc failed",
)
# What a signature puts in the place of what differs between occurrences, in order.
PLACEHOLDERS = (
    (r"\s+", " "),
    (r"0x[0-9a-f]+", "<hex>"),
    (r"state ['\"][^'\"]+['\"]", "state <state>"),
    (r"(pgmpy output for) ['\"][^'\"]+['\"]", "$1 <var>"),
    (r"\b(node|variable|var) ['\"][^'\"]+['\"]", "$1 <var>"),
    (r"\bn\d+[a-z0-9_]*\b", "<var>"),
    (r"\d{3,}", "<num>"),
    (r"\s+", " "),
)


def error_signature(kind: Column, message: Column) -> Column:
    """An error's type and message without what differs from one occurrence to another; ``unknown`` for none."""
    said = F.when(F.coalesce(kind, F.lit("")) != "", F.concat(kind, F.lit(": "), F.coalesce(message, F.lit("")))).otherwise(F.coalesce(message, F.lit("")))
    plain = F.trim(reduce(lambda m, r: F.regexp_replace(m, *r), PLACEHOLDERS, F.lower(F.trim(said))))
    return F.when(plain == "", "unknown").otherwise(plain)


def is_out_of_memory(kind: Column, message: Column) -> Column:
    said = F.lower(F.concat_ws(" ", kind, message))
    return reduce(Column.__or__, [F.contains(said, F.lit(x)) for x in OUT_OF_MEMORY])


def whole_number(text: Column) -> Column:
    """An integer from text such as ``3`` or ``3.0``; null for anything else."""
    x = text.try_cast("double")
    return F.when(x == F.floor(x), x).cast("long")


def sanitised(value: Column, nonnegative: bool = False) -> Column:
    """A finite number or null, with negative values of a nonnegative measure as 0."""
    x = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))) if nonnegative else x


def outcome(ok: Column, output: Column, error: Column) -> Column:
    """Whether an attempt succeeded: what it says itself, else an output, else an error; null if none tells."""
    return F.coalesce(ok, F.when(output.isNotNull(), True), F.when(error.isNotNull(), False))


def query_type(mode: Column) -> Column:
    return F.when(F.lower(mode).isin("cpds", "cpd"), "cpd").otherwise(F.lower(mode))


def method_id(model: Column, config_id: Column, config_hash: Column) -> Column:
    """``model/config``: its id, the first eight signs of its hash, or ``unknown``."""
    return F.concat_ws("/", model, F.coalesce(config_id, F.substring(config_hash, 1, 8), F.lit("unknown")))


def evidence_values(top: Column, nested: Column) -> Column:
    """The map of evidence without its nulls: the record's own, else that of its ``evidence``."""
    return F.map_filter(F.coalesce(top, nested), lambda _, v: v.isNotNull())


def support_or_range(support: Column, probs: Column) -> Column:
    """The declared support, or the codes 0..k-1."""
    k = F.size(probs)
    return F.coalesce(support, F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>")))


def compact_id(problem: Column, kind: Column, index: Column) -> Column:
    return F.concat_ws("::", problem, kind, index.cast("string"))


def partition_key(kind: Column, problem: Column, skeleton: Column, target: Column, task: Column, query_id: Column, *fields: Column) -> Column:
    """What makes two attempts one query: the skeleton with target and task, else the id, else all fields; null without type or problem."""
    parts = [F.coalesce(c.cast("string"), F.lit("-")) for c in fields]
    by_skeleton = F.concat_ws("|", F.lit("s"), kind, problem, skeleton, F.coalesce(target, F.lit("-")), F.coalesce(task, F.lit("-")))
    key = F.when(skeleton.isNotNull(), by_skeleton).when(query_id.isNotNull(), F.concat_ws("|", F.lit("i"), kind, problem, query_id)).otherwise(F.concat_ws("|", F.lit("f"), kind, problem, *parts))
    return F.when(kind.isNotNull() & problem.isNotNull(), key)


def ground_truth(samples: Column, probs: Column, dotted: Column, own: Column) -> Column:
    """The first that is there: probabilities counted from samples come before given ones, those before the record's own output."""
    return F.coalesce(samples, probs, dotted, own)


def is_discrete_output(kind: Column, support: Column) -> Column:
    """A pmf over whole numbers."""
    return F.coalesce((kind == "categorical_probs") & F.forall(support, lambda x: x == F.floor(x)), F.lit(False))


def valid_answer(kind: Column, probs: Column, mean: Column, std: Column, samples: Column) -> Column:
    """Whether an answer holds what its format promises: a pmf, a finite mean and standard deviation, or samples."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    normal = finite(mean) & finite(std) & (std >= 0)
    fine = F.when(kind == "categorical_probs", validated(probs).isNotNull()).when(kind == "normal_params", normal).when(kind == "samples", F.size(samples) > 0)
    return F.coalesce(fine, F.lit(False))


def mode_of(probs: Column) -> Column:
    """The index of the largest probability, the first among equal ones."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def error_bars(centre: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Lengths of the bars below and above a centre, never negative."""
    return F.greatest(centre - low, F.lit(0.0)), F.greatest(high - centre, F.lit(0.0))


def matches_model(name: Column, config: Column, wanted: list[str]) -> Column:
    """Whether a model is asked for by its name, its configuration or ``name/config``."""
    return name.isin(*wanted) | config.isin(*wanted) | F.concat_ws("/", name, config).isin(*wanted)
