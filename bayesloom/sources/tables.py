"""Reading and writing tables, JSON lines, and network files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet, CSV with a header, ORC or JSON lines, by the path's suffix."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix in ("parquet", "orc"):
        return spark.read.format(suffix).load(path)
    if suffix == "csv":
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if suffix in ("json", "jsonl"):
        return read_jsonl(spark, path, schema) if schema else spark.read.json(path)
    raise ValueError(f"no reader for {path!r}")


def read_jsonl(spark: SparkSession, path: str, schema: StructType, per_file: int | None = None) -> DataFrame:
    """Objects of JSON lines; blank and malformed lines and other values are skipped; at most ``per_file`` of each file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    rows = lines.where(F.col("value").rlike(r"^\s*\{")).withColumn("_r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).where(F.get_json_object("value", "$").isNotNull())
    if per_file is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_file").orderBy("_block", "_at"))).where(F.col("_n") <= per_file)
    return rows.select("_r.*")


def write_table(df: DataFrame, path: str, sort: bool = False) -> None:
    """By suffix; ``sort`` orders by all columns first, for small report tables."""
    suffix = path.rpartition(".")[2].lower()
    rows = df.orderBy(*df.columns).coalesce(1) if sort else df
    writer = rows.write.mode("overwrite")
    if suffix == "csv":
        writer.option("header", True).csv(path)
    elif suffix in ("json", "jsonl"):
        writer.json(path)
    elif suffix in ("parquet", "orc"):
        writer.format(suffix).save(path)
    else:
        raise ValueError(f"no writer for {path!r}")


def choose_data_file(files: DataFrame, seed: int, path: str = "path", modified: str = "modified") -> DataFrame:
    """Of ``data_<strategy>_n<N>_seed<S>`` files: the largest of the seed, else the newest of all; one row."""
    named = files.withColumn("n", F.regexp_extract(path, r"data_[^/]+?_n(\d+)_seed\d+", 1).try_cast("long")).withColumn("s", F.regexp_extract(path, r"_seed(\d+)", 1).try_cast("long"))
    own = F.coalesce(F.col("s") == seed, F.lit(False))
    return named.orderBy(own.desc(), F.when(own, F.col("n")).desc_nulls_last(), F.when(own, F.col(path)).desc_nulls_last(), F.col(modified).desc()).limit(1).select(path)


def from_arrays(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A table from one list for each column, all of one length; a list of lists becomes an array column."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError(f"columns differ in length: { {c: len(v) for c, v in columns.items()} }")
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))


def write_first(df: DataFrame, path: str, order: tuple[str, ...] = ("parquet", "csv", "json")) -> str:
    """The path (``path`` with the format as suffix) of the first format of ``order`` that can hold the table, e.g. not CSV for arrays."""
    why = []
    for suffix in order:
        try:
            write_table(df, f"{path}.{suffix}")
            return f"{path}.{suffix}"
        except Exception as e:  # the next format may do
            why.append(f"{suffix}: {type(e).__name__}")
    raise ValueError(f"no format holds the table: {'; '.join(why)}")


def write_report(df: DataFrame, path: str) -> None:
    """A report table, sorted by all its columns, as ``<path>.csv`` and as a markdown table in ``<path>.md``."""
    write_table(df, f"{path}.csv", sort=True)
    names = df.columns
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(names) + " |"), (1, "|" + "---|" * len(names))], "at int, value string")
    body = df.orderBy(*names).select(F.lit(2).alias("at"), *names).coalesce(1).select("at", row.alias("value"))
    head.coalesce(1).union(body).coalesce(1).select("value").write.mode("overwrite").text(f"{path}.md")


def clean_arcs(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``parent, child``: distinct arcs between known nodes (``node``), without self-loops."""
    rows = arcs.where("parent <> child").select("parent", "child").distinct()
    for end in ("parent", "child"):
        rows = rows.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return rows.select("parent", "child")


def network_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``id, name, category, type, nodes, arcs, parameters`` of a JSON object of networks by id."""
    entry = "struct<name:string,category:string,type:string,stats:struct<nodes:long,arcs:long,parameters:long>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("id", "n"))
    return rows.select("id", "n.name", "n.category", "n.type", "n.stats.*")


def latest_bundle(bundles: DataFrame, keys: list[str], modified: str = "modified") -> DataFrame:
    """The bundle of each of ``keys`` (mode, generator) that was changed last; of those at once, the last by path."""
    rows = bundles.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in bundles.columns if c not in keys]), F.struct(modified, "path")).alias("b"))
    return rows.select(*keys, "b.*")


def spec_tables(spark: SparkSession, spec: dict[str, dict]) -> tuple[dict[str, list[str]], dict[str, DataFrame]]:
    """Parents and tables of a network given as ``{node: {states, parents, rows}}``, rows by the parents' states in order.

    Rows are normalised; a row for each combination of the parents' states is needed, or ``default``.
    """
    from itertools import product

    out = {}
    for node, given in spec.items():
        parents, data = given.get("parents", []), []
        for combo in product(*[spec[p]["states"] for p in parents]):
            probs = given["rows"].get(combo, given.get("default"))
            if probs is None or len(probs) != len(given["states"]):
                raise ValueError(f"{node}: no row of {len(given['states'])} for {combo}")
            data += [(*combo, s, p / sum(probs)) for s, p in zip(given["states"], probs, strict=True)]
        out[node] = spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in [*parents, node]) + ", prob double")
    return {n: list(g.get("parents", [])) for n, g in spec.items()}, out


BLOCK = re.compile(r"(variable|probability)\s+([^{]*)\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}")


def parse_bif(text: str) -> tuple[dict[str, list[str]], dict[str, list[str]], dict[str, list[tuple[tuple[str, ...], list[float]]]]]:
    """States, parents and rows (parent states, probabilities) of each variable of a BIF network file.

    ``table`` rows have no parent states; a ``default`` row stands under the key ``("default",)``.
    """
    text = re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.DOTALL)
    states, parents, rows = {}, {}, {}
    for kind, head, body in BLOCK.findall(text):
        if kind == "variable":
            found = re.search(r"type\s+discrete\s*\[\s*\d+\s*\]\s*\{([^}]*)\}", body)
            states[head.strip()] = [s.strip().strip('"') for s in found[1].split(",")] if found else []
        else:
            child, _, given = head.strip().strip("()").partition("|")
            child = child.strip()
            parents[child] = [p.strip() for p in given.split(",") if p.strip()]
            rows[child] = []
            for line in body.split(";"):
                m = re.match(r"\s*(table|default|\(([^)]*)\))\s*(.*)", line, re.DOTALL)
                if m:
                    key = tuple(x.strip().strip('"') for x in m[2].split(",")) if m[2] is not None else ("default",) if m[1] == "default" else ()
                    rows[child].append((key, [float(x) for x in m[3].replace(",", " ").split()]))
    for child, r in rows.items():  # states that are not declared take the width of the rows
        if not states.get(child) and r:
            states[child] = [f"s{i}" for i in range(len(r[0][1]))]
    return states, parents, rows


def bif_tables(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """A table (parents, child, ``prob``) for each variable, normalised; missing parent rows need a default."""
    from itertools import product

    states, parents, rows = parse_bif(text)
    out = {}
    for child, given in parents.items():
        known = dict(rows[child])
        data = []
        for combo in product(*[states[p] for p in given]):
            probs = known.get(combo, known.get(("default",), known.get((), None) if not given else None))
            if probs is None and () in known:  # one flat table over all parent rows
                flat, k = known[()], len(states[child])
                at = 0
                for p, s in zip(given, combo, strict=True):
                    at = at * len(states[p]) + states[p].index(s)
                probs = flat[at * k : (at + 1) * k]
            if not probs:
                raise ValueError(f"{child}: no row for {combo}")
            total = sum(probs)
            data += [(*combo, s, p / total) for s, p in zip(states[child], probs, strict=True)]
        out[child] = spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in [*given, child]) + ", prob double")
    return out
