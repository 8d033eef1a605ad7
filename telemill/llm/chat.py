"""Chat formatting by Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become one turn of the
template. A formatted conversation is a run of

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT ...<|end|>\\n

where ``<|next|>`` parts the texts of merged turns, so that the input turns can be read back. Control strings inside roles
and texts get one more backslash behind their first character, and lose it on reading. The loss mask is one span per text,
in order, with a flag: is it trained on? Spans count code points and, for readers that cut bytes, bytes of UTF-8 too.

Defined cases: null roles and texts are empty; rows of a null conversation id form one conversation; null turn numbers
come first, equal ones are ordered by role and text; repeated rows are turns of their own; a conversation's string is
one value, as large as its turns; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"
_CONTROL = r"(\||/?s>|/?INST\])"  # what makes a control string of a < or [
_SLICE = 256


def _once(frame: DataFrame, *columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often later steps use them.

    Spark merges successive projections and repeats an expression wherever its column is used; a generator keeps them apart.
    """
    return frame.select("*", F.inline(F.array(F.struct(*columns))))


def escape(text: Column) -> Column:
    escaped = F.regexp_replace(text, r"(<|\[)(\\*)" + _CONTROL, r"$1\\$2$3")
    return F.when(F.contains(text, F.lit("<")) | F.contains(text, F.lit("[")), escaped).otherwise(text)


def unescape(text: Column) -> Column:
    read = F.regexp_replace(text, r"(<|\[)\\(\\*)" + _CONTROL, "$1$2$3")
    return F.when(F.contains(text, F.lit("\\")), read).otherwise(text)


def _sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it; in slices, so that long arrays cost little more than their length."""
    def running(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _SLICE).cast("int")),
                         lambda k: F.slice(lengths, k * _SLICE + 1, _SLICE))
    bases = running(F.transform(slices, lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x)),
                    F.lit(0).cast("long"))
    return F.flatten(F.transform(slices, lambda s, k: F.slice(running(s, F.get(bases, k)), 1, F.size(s))))


def format_conversations(turns: DataFrame, learn_role: str = "assistant", id_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted (string) and spans (array of start, length, byte_start, byte_length, learn), a row per conversation."""
    empty = F.lit("")
    source = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        escape(F.coalesce(F.col(role_col).cast("string"), empty)).alias("role"),
        escape(F.coalesce(F.col(text_col).cast("string"), empty)).alias("text"))
    sorted_turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = source.groupBy("conv_id").agg(sorted_turns.alias("turns"))
    turn = F.col("turns")

    def lead(t: Column, i: Column) -> Column:
        opening = F.concat(F.lit(TURN), t["role"], F.lit(TEXT))
        return (F.when(i == 0, opening).when(F.get(turn, i - 1)["role"] == t["role"], F.lit(NEXT))
                .otherwise(F.concat(F.lit(END), opening)))

    pieces = _once(grouped, F.transform(turn, lambda t, i: F.struct(
        lead(t, i).alias("lead"), t["text"].alias("text"), (t["role"] == escape(F.lit(learn_role))).alias("learn"))
    ).alias("pieces")).select("conv_id", "pieces")
    piece = F.col("pieces")

    def before(size) -> Column:
        return _sums_before(F.transform(piece, lambda p: (size(p["lead"]) + size(p["text"])).cast("long")))

    sized = _once(
        pieces, F.concat(F.array_join(F.transform(piece, lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(END)).alias("formatted"),
        before(F.length).alias("before"), before(F.octet_length).alias("bytes_before"))
    spans = F.transform(piece, lambda p, i: F.struct(
        (F.get(F.col("before"), i) + F.length(p["lead"])).alias("start"), F.length(p["text"]).cast("long").alias("length"),
        (F.get(F.col("bytes_before"), i) + F.octet_length(p["lead"])).alias("byte_start"),
        F.octet_length(p["text"]).cast("long").alias("byte_length"), p["learn"].alias("learn")))
    return _once(sized, spans.alias("spans")).select("conv_id", "formatted", "spans")


def read_turns(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of role, text, length as formatted) parsed from ``formatted`` alone."""
    runs = F.split("formatted", r"<\|turn\|>")
    runs = F.slice(runs, 2, F.size(runs))

    def parse(run: Column) -> Column:
        role = F.substring_index(run, TEXT, 1)
        skip = F.length(role) + len(TEXT)
        texts = F.split(F.substr(run, skip + 1, F.length(run) - skip - len(END)), r"<\|next\|>")
        return F.transform(texts, lambda t: F.struct(
            unescape(role).alias("role"), unescape(t).alias("text"), F.length(t).cast("long").alias("length")))

    return _once(formatted, F.flatten(F.transform(runs, parse)).alias("turns"))


def masked_texts(formatted: DataFrame) -> Column:
    """The texts under the loss mask, cut out of ``formatted`` at the spans' bytes and unescaped; array of string."""
    learnt = F.filter("spans", lambda s: s["learn"])

    def cut(whole: Column) -> Column:
        return F.transform(learnt, lambda s: unescape(
            F.substring(whole, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string")))

    # the bytes are a lambda variable, so they are made once a conversation and not once a span
    return F.flatten(F.transform(F.array(F.col("formatted").cast("binary")), cut))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turns parsed from the string, and the text under the loss mask."""
    turns = F.col("turns")
    read = _once(read_turns(formatted), F.array_join(masked_texts(formatted), "").alias("loss"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
