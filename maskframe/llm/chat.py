"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged by an array
aggregation, and the template is put together by concatenation:

    <s>role<msg>text<sep>text</s> ...        one <s> ... </s> for each run of turns of one role

Control strings inside texts and roles are escaped by a backslash after their first character, and backslashes are
doubled, so that every text can be read back and no text can end its turn. With the formatted text comes the loss mask:
the spans (start, length in code points) of the assistant's texts, as they stand in the formatted text.

Defined cases: null text and null role count as empty; turns sort by (turn, role, text), null turns first; repeated
rows are turns of their own; rows with a null conversation id form one conversation; an empty table gives an empty
result; further columns are not read. A conversation is one row of the result, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, BODY, BETWEEN, END = "<s>", "<msg>", "<sep>", "</s>"
#: Strings that must not stand in a text: our marks and those of common public templates.
CONTROL = (START, END, BODY, BETWEEN, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
assert not any(c[0] in "<[" and "<" in c[2:] or "[" in c[1:] for c in CONTROL), "a control string must not begin inside another"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(\\?)", "$1")


def format_chats(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans."""
    each = F.struct(rows[turn].alias("turn"), F.coalesce(rows[role], F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text"))
    turns = rows.groupBy(rows[conv].alias("conv_id")).agg(F.array_sort(F.collect_list(each)).alias("turns"))
    # runs of one role: a fold that appends to the last run or begins another
    no_runs = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def fold(runs: Column, t: Column) -> Column:
        last = F.element_at(runs, -1)
        one = F.struct(t["role"].alias("role"), F.array(escaped(t["text"])).alias("texts"))
        more = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(escaped(t["text"]))).alias("texts"))
        grown = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(more))
        return F.when((F.size(runs) > 0) & (F.get(runs, F.size(runs) - 1)["role"] == t["role"]), grown).otherwise(F.concat(runs, F.array(one)))

    runs = turns.select("conv_id", F.aggregate("turns", no_runs, fold).alias("runs"))
    # pieces: what stands before a text, and the text; the offsets of the texts are running sums of lengths
    pieces = F.flatten(
        F.transform(
            "runs",
            lambda r, k: F.transform(
                r["texts"],
                lambda t, i: F.struct(
                    F.when(i > 0, F.lit(BETWEEN)).otherwise(F.concat(F.when(k > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), escaped(r["role"]), F.lit(BODY))).alias("before"),
                    t.alias("text"),
                    (r["role"] == learn).alias("learn"),
                ),
            ),
        )
    )
    flat = runs.select("conv_id", pieces.alias("pieces"))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def measure(s: Column, p: Column) -> Column:
        start, n = s["at"] + F.length(p["before"]), F.length(p["text"]).cast("long")
        span = F.array(F.struct(start.alias("start"), n.alias("length")))
        return F.struct((start + n).alias("at"), F.when(p["learn"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), "")
    return flat.select(
        "conv_id", F.concat(whole, F.when(F.size("pieces") > 0, F.lit(END)).otherwise(F.lit(""))).alias("formatted"), F.aggregate("pieces", state, measure)["spans"].alias("loss_spans")
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted text."""
    runs = F.filter(F.split(formatted, END), lambda r: r != "")

    def of_run(run: Column) -> Column:
        # split at the first mark: roles are escaped, so it is the template's
        n = F.locate(BODY, run)
        role = unescaped(run.substr(F.lit(len(START) + 1), n - len(START) - 1))
        return F.transform(F.split(run.substr(n + len(BODY), F.length(run)), BETWEEN), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(runs, of_run))


def under_mask(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescaped(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digests(chats: DataFrame) -> DataFrame:
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(format_chats(rows.unionByName(probe)))
