"""Chat formatting in budgeted windows.

A conversation becomes one or more training windows of at most `budget` tokens. Running
sums of its turns' tokens (prefix sums, kept for the turns in reach only) choose the spans: a window takes the system turn (if the
conversation opens with one), then some of the turns that came before, at most
`history` tokens of them, then as many new turns as fit, whole turns only. What is
repeated is masked: the loss covers each assistant text once, in the window in which
it is new. Every window but the one that holds it as new takes the system turn. A turn that
exceeds the budget, alone or together with the system turn, gets a window without other turns,
uncut; only such windows exceed the budget.

Template: <|im_start|>role NEWLINE text <|im_end|> NEWLINE. In texts and roles one
backslash is put into every "<|" (and one more into every "<", backslashes, "|"), so no
control string of the template can arise from them; the reverse takes it out again. In
roles backslash and newline are written as two letters first.

Turns are dealt by conversation, sorted within the partition and streamed: memory holds
the turns of one window and its history, however long a conversation is.

Defined results. Null text or role: empty. Turns are ordered by turn (null first), then
role and text, so repeated rows all stand. Rows without conv_id form one conversation.
Empty table: empty result. Extra columns are ignored.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder, read_spec

BUDGET, HISTORY = 1024, 256
START, END = "<|im_start|>", "<|im_end|>\n"
WINDOWS = "conv_id long, window int, first_turn int, repeated int, n_turns int, n_tokens int, formatted string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text starts and ends."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str):
    """(role, text, start and end of the escaped text) of the turns of a window."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        stop = formatted.index(END, line)
        yield unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : stop]), line + 1, stop
        at = stop + len(END)


class _Conversation:
    """Streams one conversation's turns into windows."""

    def __init__(self, conv_id, count, budget, history):
        self.id, self.count, self.budget, self.history = conv_id, count, budget, history
        self.system, self.past, self.new = None, [], []  # turns: (number, role, formatted, start, end, tokens)
        self.turn = self.window = 0

    def add(self, role, text):
        formatted, a, e = turn_text(role, text)
        turn = (self.turn, role, formatted, a, e, self.count(formatted))
        self.turn += 1
        if self.new and self.used + turn[5] > self.budget:
            yield self.close()
        if not self.new:
            self.begin(turn[5])
        self.new.append(turn)
        self.used += turn[5]

    def begin(self, need):
        """Choose what to repeat: the system turn, then the longest run of latest turns that leaves room for the next turn."""
        self.before = [self.system] if self.system else []
        room = min(self.history, self.budget - need - sum(t[5] for t in self.before))
        chosen = []
        for t in reversed(self.past):
            if t[5] > room:
                break
            room -= t[5]
            chosen.append(t)
        self.before += reversed(chosen)
        self.used = sum(t[5] for t in self.before)

    def close(self):
        text, loss = "", []
        parts = []
        at = 0
        for i, t in enumerate([*self.before, *self.new]):
            if i >= len(self.before) and t[1] == "assistant":
                loss.append({"start": at + t[3], "end": at + t[4]})
            parts.append(t[2])
            at += len(t[2])
        text = "".join(parts)
        row = (self.id, self.window, self.new[0][0], len(self.before), len(self.before) + len(self.new), self.used, text, loss)
        if self.new[0][0] == 0 and self.new[0][1] == "system":
            self.system = self.new[0]
        # Only as much of the past is held as history could repeat.
        self.past, size = [], 0
        for t in reversed([x for x in (*self.before, *self.new) if x is not self.system]):
            if size + t[5] > self.history:
                break
            size += t[5]
            self.past.insert(0, t)
        self.new = []
        self.window += 1
        return row


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """Training windows of all conversations: formatted text, spans under the loss, and which leading turns are repeats.

    Rows leave each partition by conversation and window, in order.
    """
    spark = conversations.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    c = conversations
    turns = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), F.coalesce(c["role"], F.lit("")).alias("role"), F.coalesce(c["text"], F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    names = [x.split()[0] for x in WINDOWS.split(", ")]

    def rows(batches):
        count = encoder(spec.value).count
        now, out, size = None, [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

        for b in batches:
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if now is None or now.id != conv:
                    if now is not None:
                        out.append(now.close())
                    now = _Conversation(conv, count, budget, history)
                out.extend(now.add(role, text))
                size += len(text)
                if size > 1 << 22 and out:
                    yield batch()
                    out, size = [], 0
        if now is not None:
            out.append(now.close())
        if out:
            yield batch()

    return turns.mapInArrow(rows, WINDOWS)


def digest(formatted: DataFrame) -> DataFrame:
    """What windows() wrote, read back: per conversation its turns and everything under the loss mask, hashed.

    Takes the rows as windows() orders them, so a conversation is streamed window by window.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def rows(batches):
        now, state = None, None

        def done():
            return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for b in batches:
            out = []
            for conv, repeated, text, loss in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("conv_id", "repeated", "formatted", "loss"))):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(done())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for i, (role, body, _, _) in enumerate(parse(text)):
                    if i >= repeated:
                        state[0] += 1
                        state[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    part = unescape(text[span["start"] : span["end"]])
                    state[2] += len(part)
                    state[3].update(part.encode())
                state[4] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(), kinds)], names=names)

    return formatted.mapInArrow(rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat(spark, sf_dir: str) -> DataFrame:
    """Contract query: all conversations, and one made of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digest(windows(rows.unionByName(extra)))
