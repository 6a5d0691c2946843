"""Chat logs to training text: events folded to final messages, rendered, and read back.

A log is a table of events `(conv_id, message, seq, kind, role, text)`. The kinds:

- `message`: opens a message or gives it a new whole text.
- `delta`: appends a streamed piece.
- `edit`: replaces the text; the messages after it stay.
- `regenerate`: clears the message and every message with a later place; what comes in afterwards
  fills them anew. A message that is not filled again is gone.

A message has the place of its first event, whatever happens to it later. An event that was
delivered twice counts once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

KINDS = {"regenerate": 0, "message": 1, "edit": 2, "delta": 3}
FIRST = -(1 << 63)
#: Sequence numbers that one window looks at; longer conversations are summed block by block.
BLOCK = 4096

# Markers of public chat templates, and strings that tokenizers read as control.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<unk>", "[INST]",
            "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Template:
    """How a turn is marked: `<open>role newline text <close> newline`.

    In texts and roles, a control string gets a backslash after its first character; where
    backslashes stand there already, one more. Nothing else changes, so taking one away again
    gives the text back. For that, no control string may begin inside another, or hold a
    backslash. In roles, backslash and newline are written `\\b` and `\\n` before.
    """

    open: str = OPEN
    close: str = CLOSE
    controls: tuple[str, ...] = CONTROLS
    loss_roles: tuple[str, ...] = ("assistant",)
    rests: dict[str, str] = field(init=False, repr=False, compare=False, default_factory=dict)

    def __post_init__(self):
        every = tuple(dict.fromkeys([self.open, self.close, *self.controls]))
        for one in every:
            if len(one) < 2 or "\\" in one:
                raise ValueError(f"{one!r} cannot be a control string")
            for i in range(1, len(one)):
                if any(one[i:].startswith(x) or x.startswith(one[i:]) for x in every):
                    raise ValueError(f"a control string begins inside {one!r}")
        for one in every:
            after = "".join("\\" + c if not c.isalnum() else c for c in one[1:])
            known = self.rests.get(one[0])
            self.rests[one[0]] = f"{known}|{after}" if known else after

    def _places(self, between: str) -> str:
        """Pattern for the places right after the first character of a control string."""
        return "|".join(rf"(?<=\{first}){between}(?=\\*(?:{rest}))"
                        for first, rest in self.rests.items())

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self._places("")), F.lit("\\\\"))

    def escaped_role(self, role: Column) -> Column:
        plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))
        return self.escaped(plain)

    def reader(self) -> tuple[re.Pattern, re.Pattern]:
        """Patterns of a whole turn, and of the backslashes that escaping has put in."""
        turn = re.compile(f"{re.escape(self.open)}([^\n]*)\n(.*?){re.escape(self.close)}\n", re.S)
        return turn, re.compile(self._places(r"\\"))


def _key(name: str) -> Column:
    """A column as text that is never NULL; NULL is a key of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def log_of_rows(rows: DataFrame) -> DataFrame:
    """Finished messages `(conv_id, turn, role, text)` as a log with one event each.

    NULL role and text are empty; a NULL turn comes first. Rows of a conversation with the same
    turn are ordered by role, then by the md5 of the text; rows that repeat everything are as many
    messages.
    """
    counted = rows.groupBy("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                           F.coalesce("text", F.lit("")).alias("text")).count()
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy")
    return counted.select("conv_id", "turn", "role", "text", copy).select(
        "conv_id", F.concat_ws(":", _key("turn"), "role", F.md5("text"),
                               F.lpad(F.col("copy").cast("string"), 12, "0")).alias("message"),
        F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("seq"),
        F.lit("message").alias("kind"), "role", "text")


def running(rows: DataFrame, value: Column, combine, out: str, keys: Sequence[str] = ("conv",),
            at: str = "seq", order: Sequence[str] = ("seq", "msg")) -> DataFrame:
    """`out`: `value` combined over the rows of the same keys that come before (NULL for the first).

    In two steps, so that a conversation with a third of all rows is not one window: totals of
    blocks of `BLOCK` numbers, a window over those, and a window inside each block.
    """
    dealt = rows.withColumn("block", F.floor(F.col(at) / BLOCK)).withColumn("value", value)
    past = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy(*keys, "block").agg(combine("value").alias("total")).select(
        *keys, "block", combine("total").over(past).alias("past"))
    inside = Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    return dealt.withColumn("inside", combine("value").over(inside)).join(
        blocks, [*keys, "block"]).withColumn(
        out, combine_two(combine, "past", "inside")).drop("block", "value", "inside", "past")


def combine_two(combine, a: str, b: str) -> Column:
    if combine is F.max:
        return F.greatest(a, b)
    return F.when(F.col(a).isNotNull() | F.col(b).isNotNull(),
                  F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def final_messages(log: DataFrame) -> DataFrame:
    """Fold a log: `(conv_id, conv, seq, msg, role, text)`, one row per message that is left.

    The events of a message are folded in the order of `seq`; at the same number a regeneration
    comes first, then whole texts, edits and deltas, each by text. What a regeneration clears
    further down is found from the messages' places alone, without their texts, and only in
    conversations that have one; an event with the number of the regeneration stays. A message's
    role is the first that any of its events names. NULL texts and roles are empty, a NULL `seq`
    is the smallest number, a NULL kind is `message`, any other kind is an error. Events are
    grouped by message, so the size of a conversation does not matter here.
    """
    kind = F.coalesce("kind", F.lit("message"))
    rank = reduce(lambda c, k: c.when(kind == k, F.lit(KINDS[k])), KINDS, F.when(F.lit(False), 0))
    events = log.select(
        "conv_id", _key("conv_id").alias("conv"), _key("message").alias("msg"),
        F.coalesce(F.col("seq").cast("long"), F.lit(FIRST)).alias("seq"),
        rank.otherwise(F.raise_error(F.concat(F.lit("unknown kind "), kind)).cast("int")).alias("rank"),
        "role", F.coalesce("text", F.lit("")).alias("text"))

    regenerated = F.max(F.when(F.col("rank") == 0, F.col("seq")))
    asked = events.where("rank = 0").select("conv").distinct()
    places = events.join(asked, "conv", "left_semi").groupBy("conv", "msg").agg(
        F.min("seq").alias("seq"), regenerated.alias("again"))
    cuts = running(places, F.col("again"), F.max, "cut").where("cut IS NOT NULL").select(
        "conv", "msg", "cut")

    messages = events.groupBy("conv", "msg").agg(
        F.min("conv_id").alias("conv_id"), F.min("seq").alias("seq"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "rank", "role"))).alias("named"),
        F.sort_array(F.collect_set(F.struct("seq", "rank", "text"))).alias("events"))
    start = F.struct(F.lit(False).alias("there"), F.array().cast("array<string>").alias("pieces"))

    def step(state: Column, event: Column) -> Column:
        whole = F.struct((event["rank"] > 0).alias("there"),
                         F.when(event["rank"] > 0, F.array(event["text"])).otherwise(
                             F.array().cast("array<string>")).alias("pieces"))
        more = F.struct(F.lit(True).alias("there"), F.concat(
            state["pieces"], F.array(event["text"])).alias("pieces"))
        return F.when(event["rank"] == KINDS["delta"], more).otherwise(whole)

    # Only what follows the last whole text counts: the fold never grows with dead events.
    left = messages.join(cuts, ["conv", "msg"], "left").withColumn("events", F.filter(
        "events", lambda e: F.col("cut").isNull() | (e["seq"] >= F.col("cut"))))
    last = F.array_max(F.transform(F.filter("events", lambda e: e["rank"] < KINDS["delta"]),
                                   lambda e: F.struct(e["seq"], e["rank"], e["text"])))
    live = F.filter("events", lambda e: F.col("last").isNull() | (
        F.struct(e["seq"], e["rank"], e["text"]) >= F.col("last")))
    folded = left.withColumn("last", last).withColumn("state", F.aggregate(live, start, step))
    return folded.where("state.there").select(
        "conv_id", "conv", "seq", "msg", F.coalesce("named.role", F.lit("")).alias("role"),
        F.array_join("state.pieces", "").alias("text"))


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """One rendered piece per message: `(conv_id, conv, seq, msg, piece, loss_from, loss_to)`.

    `loss_from` and `loss_to` are code points of the piece that hold the (escaped) text of a role
    that is learnt, NULL for the other roles.
    """
    learnt = F.col("role").isin(*template.loss_roles)
    parts = messages.select(
        "conv_id", "conv", "seq", "msg", learnt.alias("learnt"),
        F.concat(F.lit(template.open), template.escaped_role(F.col("role")),
                 F.lit("\n")).alias("head"), template.escaped(F.col("text")).alias("body"))
    begin = F.when(F.col("learnt"), F.length("head"))
    return parts.select(
        "conv_id", "conv", "seq", "msg",
        F.concat("head", "body", F.lit(template.close + "\n")).alias("piece"),
        begin.alias("loss_from"), (begin + F.length("body")).alias("loss_to"))


def documents(pieces: DataFrame, max_chars: int = 1 << 20) -> DataFrame:
    """`(conv_id, conv, part, text, spans array<struct<start, stop>>)`: the training documents.

    A conversation up to `max_chars` is one document. A longer one is cut between turns: a piece
    belongs to the part in which it begins, so no task ever holds a whole endless conversation,
    and the parts in order are the conversation. `spans` are the code points under the loss mask.
    """
    pieces = stage(pieces.withColumn("chars", F.length("piece").cast("long")), "chat-pieces")
    slim = pieces.select("conv", "seq", "msg", "chars")
    long = stage(slim.groupBy("conv").agg(F.sum("chars").alias("all")).where(
        F.col("all") > max_chars).select("conv"), "chat-long")
    parts = running(slim.join(long, "conv", "left_semi"), F.col("chars"), F.sum, "begin").select(
        "conv", "msg", F.floor(F.coalesce("begin", F.lit(0)) / max_chars).alias("part"))
    turn = F.struct("seq", "msg", "piece", "chars", "loss_from", "loss_to")
    grouped = pieces.join(parts, ["conv", "msg"], "left").groupBy(
        "conv", F.coalesce("part", F.lit(0)).alias("part")).agg(
        F.min("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("turns"))

    def add(state: Column, t: Column) -> Column:
        span = F.struct((state["at"] + t["loss_from"]).alias("start"),
                        (state["at"] + t["loss_to"]).alias("stop"))
        return F.struct((state["at"] + t["chars"]).alias("at"), F.when(
            t["loss_from"].isNotNull(), F.concat(state["spans"], F.array(span))).otherwise(
            state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(
        "array<struct<start:bigint,stop:bigint>>").alias("spans"))
    return grouped.select("conv_id", "conv", "part", F.array_join("turns.piece", "").alias("text"),
                          F.aggregate("turns", start, add, lambda s: s["spans"]).alias("spans"))


def format_chats(log: DataFrame, template: Template = Template(),
                 max_chars: int = 1 << 20) -> DataFrame:
    """Fold, render and cut: the documents of every conversation of a log.

    Extra columns of the log are ignored, whatever their names. NULL conversation ids are one
    conversation. An empty log gives no rows.
    """
    return documents(render(final_messages(log), template), max_chars)


def turns_of(text: str, template: Template) -> Iterator[tuple[str, str]]:
    """The roles and texts of a rendered document; an error where it is not one."""
    turn, put_in = template.reader()
    at = 0
    for m in turn.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        role = re.sub(r"\\(.)", lambda x: {"b": "\\", "n": "\n"}[x[1]], put_in.sub("", m[1]))
        yield role, put_in.sub("", m[2])
    if at != len(text):
        raise ValueError(f"no turn at {at}")


def read_back(docs: DataFrame, template: Template = Template()) -> DataFrame:
    """Turns and learnt text as a reader of the documents finds them, one row per conversation.

    `n_turns`, `turns_sha256` (role, newline, text, newline per turn), `loss_chars` and
    `loss_sha256` (the text under the spans, escapes undone), `formatted_chars`, `n_documents`.
    A digest needs the parts of a conversation in order: they are sorted in Spark and streamed,
    and a task holds one part at a time.
    """
    conv_type = docs.schema["conv_id"].dataType
    schema = T.StructType([
        T.StructField("conv_id", conv_type), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()), T.StructField("n_documents", T.LongType())])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, put_in = template.reader()
        now, out, kind = None, [], None

        def flush(limit: int):
            nonlocal out
            if len(out) > limit:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], kind), pa.array(columns[1], pa.int64()),
                     pa.array([h.hexdigest() for h in columns[2]], pa.string()),
                     pa.array(columns[3], pa.int64()),
                     pa.array([h.hexdigest() for h in columns[4]], pa.string()),
                     pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.int64())],
                    names=schema.names)
                out = []

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for i in range(batch.num_rows):
                conv = batch["conv"][i].as_py()
                if conv != now:
                    now = conv
                    out.append([batch["conv_id"][i].as_py(), 0, hashlib.sha256(), 0,
                                hashlib.sha256(), 0, 0])
                text, row = batch["text"][i].as_py(), out[-1]
                for role, said in turns_of(text, template):
                    row[1] += 1
                    row[2].update(f"{role}\n{said}\n".encode())
                for span in batch["spans"][i].as_py():
                    learnt = put_in.sub("", text[span["start"]:span["stop"]])
                    row[3] += len(learnt)
                    row[4].update(learnt.encode())
                row[5] += len(text)
                row[6] += 1
            if len(out) > 10_000:  # the last conversation may go on in the next batch
                last = out.pop()
                yield from flush(0)
                out = [last]
        yield from flush(0)

    dealt = docs.select("conv_id", "conv", "part", "text", "spans").repartition("conv")
    return dealt.sortWithinPartitions("conv", "part").mapInArrow(digests, schema)
