r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar: a conversation is ``turn*``; a turn is ``"### " name ": " text "\n</turn>\n"``, where
the name of a known role is its capitalised form and of any other role ``=`` and its bytes in
hexadecimal. The control strings are runs of three or more ``#`` and ``</turn>``. Each turn is
rendered as it stands and parsed again by a strict parser, to which every control string
without a backslash before it is structure. Where it does not give back the role and text, the
turn is rendered once more with its control strings escaped: each gets one more backslash than
stands before it. The parser takes one backslash away again, so this second round trip is an
identity; an error is raised if it were not.

Cases: null text is empty; a null role is an empty role; rows of a null ``conv_id`` form one
conversation; turns are ordered by ``turn`` (nulls first), then role and text, so repeated rows
stay, side by side; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
#: A control string with the backslashes before it, the same with one at least, and one without any.
CONTROL = r"(?<!\\)(\\*+)(#{3,}+|</turn>)"
ESCAPED = r"(?<!\\)\\(\\*+)(#{3,}+|</turn>)"
BARE_HEAD = r"(?<![\\#])#{3,}+"
BARE_END = r"(?<!\\)</turn>"
END = "\n</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"\\$1$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2"))


def _name(role: Column) -> Column:
    return F.when(role.isin(*ROLES), F.initcap(role)).otherwise(F.concat(F.lit("="), F.hex(F.encode(role, "UTF-8"))))


def _role(name: Column) -> Column:
    other = F.decode(F.unhex(F.substring(name, 2, 1 << 30)), "UTF-8")
    return F.when(F.startswith(name, F.lit("=")), other).otherwise(F.lower(name))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), _name(role), F.lit(": "), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string as an array of (role, text); what breaks the grammar gives null texts."""
    def read(block: Column, heads: Column, lead: Column) -> Column:
        body = F.try_element_at(heads, F.lit(2))
        at = F.instr(body, ": ")
        good = (F.size(heads) == 2) & (F.try_element_at(heads, F.lit(1)) == lead) & F.startswith(body, F.lit(" ")) & (at > 1) & F.endswith(body, F.lit("\n"))
        text = F.substr(body, at + 2, F.length(body) - at - 2)
        return F.struct(_role(F.substr(body, F.lit(2), at - 2)).alias("role"), F.when(good, unescape(text)).alias("text"))

    def turn(block: Column, k: Column) -> Column:
        # an array of one element binds the split block to a name; written out, it would be split at each use
        lead = F.when(k == 0, F.lit("")).otherwise(F.lit("\n"))
        return F.element_at(F.transform(F.array(F.split(block, BARE_HEAD)), lambda heads: read(block, heads, lead)), 1)

    return F.flatten(F.transform(F.array(F.split(formatted, BARE_END)), lambda ends: F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), turn)))


def _returns(rendered: Column, role: Column, text: Column) -> Column:
    return parse(rendered) == F.array(F.struct(role.alias("role"), text.alias("text")))


def format_turns(turns: DataFrame) -> DataFrame:
    """Every row with ``rendered``, ``escaped``, and ``head``: the characters before the text in ``rendered``."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = render(F.col("role"), F.col("text"))
    tried = rows.withColumn("escaped", ~F.coalesce(_returns(plain, F.col("role"), F.col("text")), F.lit(False)))
    body = F.when(F.col("escaped"), escape(F.col("text"))).otherwise(F.col("text"))
    done = tried.withColumn("body", body).withColumn("rendered", render(F.col("role"), F.col("body")))
    same = F.coalesce(_returns(F.col("rendered"), F.col("role"), F.col("text")), F.lit(False))
    checked = F.when(~F.col("escaped") | same, F.col("rendered")).otherwise(F.raise_error(F.lit("a turn is not restored by the parser")))
    return done.withColumn("rendered", checked).withColumn("head", F.length(_name(F.col("role"))) + 6).withColumn("body_chars", F.length("body")).drop("body")


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, mask``: one string per conversation, and the (start, end) code-point spans to learn from."""
    rows = format_turns(turns)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum(F.length("rendered")).over(order), F.lit(0)) + F.col("head"))
    item = F.struct("begin", "rendered", "role", (F.col("begin") + F.col("body_chars")).alias("end"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("turns"))
    learned = F.filter("turns", lambda t: t["role"] == "assistant")
    return grouped.select("conv_id", F.concat_ws("", F.transform("turns", lambda t: t["rendered"])).alias("formatted"), F.transform(learned, lambda t: F.struct(t["begin"].alias("start"), t["end"].alias("end"))).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the parser and the mask give back from ``formatted``."""
    rows = formatted.withColumn("turns", parse(F.col("formatted")))
    under = F.transform("mask", lambda m: unescape(F.substr("formatted", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    rows = rows.withColumn("loss", F.concat_ws("", under))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def conversation(spark: SparkSession, conv_id: int, said: list[tuple[str, str]]) -> DataFrame:
    """A conversation of literals, with the columns of ``conversations``."""
    turns = F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(t).alias("text")) for k, (r, t) in enumerate(said)])
    return spark.range(1).select(F.lit(conv_id).cast("long").alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.*")
