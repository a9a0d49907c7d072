r"""Chat formatting with typed content parts.

A message is a list of parts (text, image, audio, document).  A visitor with one
method per type turns a part into what stands in the formatted turn, an escaped
text or a numbered placeholder, with its attachment reference and the number of
tokens it expands to.  The visitor builds DataFrame expressions, so formatting
is one pass over the rows without Python workers and without a group.

Template of a turn::

    ### role:
    body
    </turn>

A control string in a text gets a backslash, and backslashes before it, before
another part or before the end are doubled, so an even number of backslashes
stands before every control string of the template and an odd number before
every one of a text.  The reader goes through the formatted text from its start
and does not know where rows began.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import shuffle_count

HEAD, HEAD_END, TAIL = "### ", ":\n", "\n</turn>\n"
CONTROLS = ("### ", "</turn>", "<image:", "<audio:", "<document:")
"""Fixed: all strings of the template that a text may not hold as they are."""
MEDIA = ("image", "audio", "document")
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"

_CONTROL = "|".join(re.escape(c) for c in CONTROLS)
_IN_TEXT = rf"(\\*)({_CONTROL})"
_AT_END = r"(\\+)\z"
_ROLE_CODES = (("%", "%25"), ("\n", "%0A"), (":", "%3A"), ("#", "%23"), ("<", "%3C"), ("\\", "%5C"))


def escaped(text: Column) -> Column:
    """A text in which every control string stands behind an odd number of backslashes."""
    return F.regexp_replace(F.regexp_replace(text, _IN_TEXT, r"$1$1\\$2"), _AT_END, "$1$1")


def role_name(role: Column) -> Column:
    """A role in one line of the template; null is the empty role."""
    name = F.coalesce(role.cast("string"), F.lit(""))
    for sign, code in _ROLE_CODES:
        name = F.replace(name, F.lit(sign), F.lit(code))
    return name


class PartVisitor:
    """What each type of part becomes.  ``patch``, ``audio_rate`` and ``page_tokens`` give the tokens of a placeholder.

    An image has a token for every started patch, an audio for every started
    1 / ``audio_rate`` seconds, a document ``page_tokens`` for every page; missing
    or negative measures count as 0.  A part of another type or without a type
    is a text; a null text is empty.
    """

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def visit(self, part: Column) -> Column:
        """struct(kind, body, ref, tokens) of a part; the placeholder's number is put in by the caller."""
        out = self.visit_text(part)
        for kind in MEDIA:
            out = F.when(part["type"] == kind, getattr(self, f"visit_{kind}")(part)).otherwise(out)
        return out

    def visit_text(self, part: Column) -> Column:
        return self._made("text", escaped(F.coalesce(part["text"], F.lit(""))), F.lit(None).cast("string"), F.lit(0))

    def visit_image(self, part: Column) -> Column:
        across, down = (F.ceil(self._measure(part[side]) / self.patch) for side in ("width", "height"))
        return self._made("image", F.lit(""), part["ref"], across * down)

    def visit_audio(self, part: Column) -> Column:
        return self._made("audio", F.lit(""), part["ref"], F.ceil(self._measure(part["seconds"]) * self.audio_rate))

    def visit_document(self, part: Column) -> Column:
        return self._made("document", F.lit(""), part["ref"], self._measure(part["pages"]) * self.page_tokens)

    @staticmethod
    def _measure(value: Column) -> Column:
        return F.when(value > 0, value).otherwise(F.lit(0))

    @staticmethod
    def _made(kind: str, body: Column, ref: Column, tokens: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.alias("body"), ref.cast("string").alias("ref"), tokens.cast("long").alias("tokens"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *[
        F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]).cast(PART))


def joined_texts(parts: Column) -> Column:
    """Texts that follow one another as one text part: a control string may stand across their border."""
    def is_text(part: Column) -> Column:
        return ~F.coalesce(part["type"].isin(*MEDIA), F.lit(False))

    def add(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        text = F.concat(F.coalesce(last["text"], F.lit("")), F.coalesce(part["text"], F.lit("")))
        both = F.array(part.withField("text", text).withField("type", F.lit("text")))
        return F.when((F.size(acc) > 0) & is_text(last) & is_text(part),
                      F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), both)).otherwise(F.concat(acc, F.array(part)))

    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), F.array().cast(f"array<{PART}>"), add)


def format_turns(turns: DataFrame, parts: Column, role: Column, learn_from: tuple[str, ...] = ("assistant",),
                 visitor: PartVisitor | None = None, keep: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """(*keep, formatted, loss, attachments, tokens) per turn: a conversation is its turns' texts in order, one after another.

    ``loss`` holds (start, stop) in code points of ``formatted``, one for every
    text of a role to learn from (none for empty ones; text parts that follow one
    another are one text); ``attachments``
    holds (number, kind, ref, start, tokens) of every placeholder, numbered in
    the turn from 1; ``tokens`` is the sum of theirs.  A null list of parts, and
    a null part in it, is an empty text.  Other columns are not read.
    """
    visitor = visitor or PartVisitor()
    visited = F.transform(joined_texts(parts), visitor.visit)
    rows = turns.select(*keep, role.alias("_role"), F.concat(F.lit(HEAD), role_name(role), F.lit(HEAD_END)).alias("_head"), visited.alias("_parts"))
    start = F.struct(F.length("_head").alias("at"), F.lit(0).alias("number"), F.array().cast(
        "array<struct<kind: string, body: string, ref: string, tokens: bigint, number: int, start: int, stop: int>>").alias("out"))

    def place(acc: Column, part: Column) -> Column:
        is_text = part["kind"] == "text"
        number = acc["number"] + F.when(is_text, 0).otherwise(1)
        body = F.when(is_text, part["body"]).otherwise(F.concat(F.lit("<"), part["kind"], F.lit(":"), number.cast("string"), F.lit(">")))
        stop = acc["at"] + F.length(body)
        placed = F.struct(part["kind"].alias("kind"), body.alias("body"), part["ref"].alias("ref"), part["tokens"].alias("tokens"),
                          number.alias("number"), acc["at"].alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), number.alias("number"), F.concat(acc["out"], F.array(placed)).alias("out"))

    rows = rows.withColumn("_parts", F.aggregate("_parts", start, place)["out"])
    learned = F.filter("_parts", lambda p: (p["kind"] == "text") & (p["stop"] > p["start"]))
    spans = F.transform(learned, lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop")))
    media = F.filter("_parts", lambda p: p["kind"] != "text")
    attachments = F.transform(media, lambda p: F.struct(*[p[c].alias(c) for c in ("number", "kind", "ref", "start", "tokens")]))
    body = F.array_join(F.transform("_parts", lambda p: p["body"]), "")
    tokens = F.aggregate("_parts", F.lit(0).cast("long"), lambda a, p: a + p["tokens"])
    return rows.select(*keep, F.concat("_head", body, F.lit(TAIL)).alias("formatted"),
                       F.when(F.col("_role").isin(*learn_from), spans).otherwise(F.array().cast("array<struct<start: int, stop: int>>")).alias("loss"),
                       attachments.alias("attachments"), tokens.alias("tokens"))


_READ = re.compile(rf"(\\*)({_CONTROL})")
_PLACEHOLDER = re.compile(r"<(?:image|audio|document):(\d+)>")


def unescaped(text: str) -> str:
    """A text part as it was: the inverse of ``escaped``."""
    halved = _READ.sub(lambda m: m[1][:len(m[1]) // 2] + m[2], text)
    end = len(halved) - len(halved.rstrip("\\"))
    return halved[:len(halved) - end // 2] if end else halved


class TurnReader:
    """Reads formatted conversations as a stream: feed it text, take complete turns (role, parts) out; holds one turn at most."""

    def __init__(self) -> None:
        self._rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, list[str | int]]]:
        """Turns completed by more text; a part is a text or the number of a placeholder."""
        self._rest += text
        while True:
            turn = self._turn()
            if turn is None:
                return
            yield turn

    def close(self) -> None:
        if self._rest:
            raise ValueError("formatted text ends inside a turn")

    def _turn(self) -> tuple[str, list[str | int]] | None:
        text = self._rest
        if not text.startswith(HEAD[:len(text)]):
            raise ValueError("no head of a turn where one should be")
        head = text.find(HEAD_END)
        if head < 0:
            return None
        role = text[len(HEAD):head]
        for sign, code in reversed(_ROLE_CODES):
            role = role.replace(code, sign)
        at, parts = head + len(HEAD_END), []
        for found in _READ.finditer(text, at):
            if len(found[1]) % 2:
                continue
            mark, start = found[2], found.start(2)
            if mark == "</turn>":
                if text[start + 7:start + 8] != "\n":
                    break
                # the line feed before the mark is the template's
                parts.append(text[at:start - 1])
                self._rest = text[start + 8:]
                return role, [p if isinstance(p, int) else unescaped(p) for p in parts if p != ""]
            held = _PLACEHOLDER.match(text, start)
            if not held:
                raise ValueError("a control string where none should be")
            parts += [text[at:start], int(held[1])]
            at = held.end()
        return None


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted turns (conv_id, turn, formatted, loss).

    The turns of a conversation come to one task in order and are read as one
    stream; a task holds a batch of rows and two running digests, however long a
    conversation is.  sha256 over a whole conversation cannot be split, so its
    turns are not either.
    """
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []

        def ended() -> None:
            reader, n, turns, chars, loss, length = state
            reader.close()
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        for batch in batches:
            for c, text, spans in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss"))):
                if state is None or c != conv:
                    if state is not None:
                        ended()
                    conv, state = c, [TurnReader(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, parts in state[0].feed(text):
                    state[1] += 1
                    own = "".join(p for p in parts if isinstance(p, str))
                    state[2].update(f"{role}\n{own}\n".encode())
                for span in spans:
                    learned = unescaped(text[span["start"]:span["stop"]])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(text)
            yield _rows(done)
            done = []
        if state is not None:
            ended()
            yield _rows(done)

    dealt = formatted.repartition(shuffle_count(formatted), "conv_id").sortWithinPartitions("conv_id", "turn", "_tie")
    return dealt.select("conv_id", "formatted", "loss").mapInArrow(digests, DIGESTS)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=list(names))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user's and an assistant's turn with control strings and a backslash before one."""
    text = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def format_and_read_back(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation and of conversation -7.

    Rows go by turn, null first, equal turns by role and text.  A null text is
    empty, a null role too, rows with a null id are one conversation.  Other
    columns are not read.  An empty table gives conversation -7 only.
    """
    asked = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = asked.unionByName(probe(conversations.sparkSession))
    rows = rows.withColumn("_tie", F.struct("role", "text"))
    made = format_turns(rows, text_parts(F.col("text")), F.col("role"), keep=("conv_id", "turn", "_tie"))
    return read_back(made)
