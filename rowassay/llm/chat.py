"""Chat formatting from typed content parts: a visitor flattens parts into text with ordered placeholders.

DataFrame functions only. A content part is a struct ``(kind, text, ref, units)``:

- ``text``: its text, escaped;
- ``image``, ``audio``, ``document``: a placeholder ``<|kind|>``; the n-th placeholder of a conversation
  belongs to the n-th entry of ``attachments``, and stands for ``units`` x the kind's rate of tokens;
- any other kind, or NULL: nothing.

The template of a turn is ``<|turn|>role<|says|>content<|end|>\\n``. Inside roles and texts ``\\`` becomes
``\\\\`` and ``<|`` becomes ``<\\|``, also where two text parts meet, so no text can hold a control string and reading back is
exact; ``read_parts`` tells a placeholder from a text that looks like one. Adjacent text parts read back as one.

Defined cases: NULL text, role or part list counts as empty; NULL units as 0; turns sort by (turn, role,
content), NULLs first; repeated rows stay; a NULL conversation id is a conversation; an empty table gives
no rows; extra columns are ignored. A conversation is one result row, so it must fit into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the template and the tokens that one unit (image tile, audio second, page) expands to.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def text_part(text: Column) -> Column:
    """A content list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units"))).cast(PARTS)


def _by_kind(part: Column, text: Column, attachment) -> Column:
    """The visitor's dispatch: one branch for texts and one for each kind of attachment."""
    choice = F.when(part["kind"] == "text", text)
    for kind, rate in TOKENS_PER_UNIT.items():
        choice = choice.when(part["kind"] == kind, attachment(kind, rate))
    return choice


def visit_content(parts: Column) -> Column:
    """The parts as one text. Until ``<|`` is escaped over the joined parts, a placeholder is ``\\!kind!``; texts hold no single ``\\`` then."""
    none = F.lit("")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(_by_kind(p, F.replace(F.coalesce(p["text"], none), F.lit("\\"), F.lit("\\\\")), lambda kind, _: F.lit(f"\\!{kind}!")), none)), "")
    escaped = F.replace(joined, F.lit("<|"), F.lit("<\\|"))
    return F.regexp_replace(escaped, r"(?<!\\)((?:\\\\)*+)\\!(" + "|".join(TOKENS_PER_UNIT) + ")!", "$1<|$2|>")


def visit_attachments(parts: Column) -> Column:
    def entry(part: Column) -> Column:
        units = F.coalesce(part["units"], F.lit(0).cast("long"))
        tokens = _by_kind(part, F.lit(None).cast("long"), lambda _, rate: units * rate)
        return F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))

    return F.transform(F.filter(parts, lambda p: p["kind"].isin(*TOKENS_PER_UNIT)), entry)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, parts).

    Returns conv_id, ``segments`` (text, loss) whose texts joined are ``formatted``, ``attachments`` (kind,
    ref, tokens) in placeholder order, and ``attachment_tokens``. The loss mask covers the contents of
    ``loss_role`` and nothing else.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    said = turns.select("conv_id", F.struct("turn", role.alias("role"), visit_content(parts).alias("content"), visit_attachments(parts).alias("attachments")).alias("t"))
    grouped = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def pieces(t: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(TURN), escape(t["role"]), F.lit(SAYS))
        return F.array(segment(head, F.lit(False)), segment(t["content"], t["role"] == loss_role), segment(F.lit(END), F.lit(False)))

    # the tree of attachments of all turns, in order
    held = grouped.select("conv_id", F.flatten(F.transform("t", pieces)).alias("segments"), F.flatten(F.transform("t", lambda t: t["attachments"])).alias("attachments"))
    return held.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped; placeholders stay in the text."""
    cut = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda t: t != "")
    return F.transform(
        cut,
        lambda t: F.struct(
            unescape(F.substring_index(F.substring(t, len(TURN) + 1, 2147483647), SAYS, 1)).alias("role"),
            unescape(F.substring_index(t, SAYS, -1)).alias("text"),
        ),
    )


def read_parts(content: Column) -> Column:
    """The parts of a formatted content: array of (kind, text), texts unescaped, empty texts left out."""
    kinds = "|".join(TOKENS_PER_UNIT)
    texts = F.transform(F.split(content, rf"<\|(?:{kinds})\|>"), lambda t: F.struct(F.lit("text").alias("kind"), unescape(t).alias("text")))
    found = F.transform(F.regexp_extract_all(content, F.lit(rf"<\|({kinds})\|>"), 1), lambda k: F.struct(k.alias("kind"), F.lit(None).cast("string").alias("text")))
    both = F.flatten(F.zip_with(texts, found, lambda t, k: F.array(t, k)))
    return F.filter(both, lambda p: p["kind"].isNotNull() & ((p["kind"] != "text") | (p["text"] != "")))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted text says when read back: counts and digests of turns and of the loss text."""
    read = conversations.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
