"""Structured Streaming: answers that arrive as byte fragments of event streams, in any order, and enter a history once.

Fragments of a stream are numbered from 0. What comes early waits in the state until its turn, what comes again is
passed over, so the same events come out whatever the order, the batches and the frames. Bytes become lines only when a
line's end is there, so a character cut in two is whole again before it is read. All bounds are kept as running counts.

Every call to the state store costs a round trip, so up to 16 streams of neighbouring numbers share a key of the state:
a list of what batches changed, read at once and appended to at once, and written anew when it is twice as long as what
holds. What waits of a stream and its answer so far leave that list for entries of their own when they pass SMALL, so
no batch writes them again; the answer is put together once, when it finishes.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from inkstone.functions import tables

#: Bounds in bytes: a line, an answer, and all that a stream brings.
MAX_LINE, MAX_ANSWER, MAX_STREAM = 262_144, 1_048_576, 8_388_608
#: Low bits of the numbers of streams that share a key of the state, and bytes of a stream's waiting fragments, or of its
#: answer, that lie there with it.
BUCKET_BITS, SMALL = 4, 16_384
EVENTS = "stream_id bigint, n bigint, kind string, text string"
TOKEN, FINISHED, FAILED, OPEN = "token", "finished", "failed", "open"
#: Why an answer fails: a bound is passed, a line isn't what it should be, the stream ends before [DONE].
LIMIT, INVALID, INCOMPLETE = "response_limit", "invalid_response", "incomplete"


class Failure(Exception):
    pass


def contents(line: bytes) -> list[str] | None:
    """The texts that an event line adds; None where the stream ends. Lines of other fields and comments add nothing."""
    if line == b"data: [DONE]":
        return None
    if not line.startswith(b"data:"):
        return []
    try:
        choices = json.loads(line[5:].removeprefix(b" ").decode("utf-8"))["choices"]
        found = [c["delta"].get("content") for c in choices]
        if not isinstance(choices, list) or any(not isinstance(x, str | None) for x in found):
            raise Failure(INVALID)
        for x in found:
            (x or "").encode("utf-8")
    except (ValueError, KeyError, TypeError, AttributeError):
        raise Failure(INVALID) from None
    return [x for x in found if x]


class LineReader:
    """Lines out of bytes that come in pieces; keeps an open line as the pieces that it came in."""

    def __init__(self, open_line: bytes = b""):
        self.pieces, self.size = ([open_line] if open_line else []), len(open_line)

    def feed(self, data: bytes) -> Iterator[bytes]:
        start = 0
        while (end := data.find(b"\n", start)) >= 0:
            line = b"".join([*self.pieces, data[start:end]]).removesuffix(b"\r")
            self.pieces, self.size, start = [], 0, end + 1
            if len(line) > MAX_LINE:
                raise Failure(LIMIT)
            yield line
        if start < len(data):
            self.pieces.append(data[start:])
            self.size += len(data) - start
            if self.size > MAX_LINE:
                raise Failure(LIMIT)


class Answer:
    """One stream: how far it is read, what waits, the text so far.

    waiting: fragments that came early; blobs: how many entries of such there are, with `listed` fragments, read ones among
    them; parts: how many entries of text there are."""

    NEW = (OPEN, 0, 0, 0, 0, 0, 0, 0, 0, b"", {}, "")

    def __init__(self, head: tuple, entries: Iterable[bytes]):
        self.status, self.following, self.seen, waiting, self.blobs, self.listed, self.parts, self.size, self.n, line, early, self.text = head
        self.was_open = self.status == OPEN
        self.reader, self.new, self.early, self.in_entries = LineReader(line), [], dict(early), set()
        if waiting > len(early):
            found = {seq: data for x in entries for seq, data in pickle.loads(x).items() if seq >= self.following}
            self.in_entries = set(found)
            self.early |= found
        self.held = sum(len(d or b"") for d in self.early.values())

    def feed(self, seq: int | None, data: bytes | None) -> Iterator[tuple[str, str]]:
        """Kind and text of what a fragment adds."""
        if self.status != OPEN or seq is None or seq < self.following or seq in self.early:
            return
        self.early[seq] = data
        self.held += len(data or b"")
        try:
            if self.seen + self.held > MAX_STREAM:
                raise Failure(LIMIT)
            while self.status == OPEN and self.following in self.early:
                data = self.early.pop(self.following)
                self.following += 1
                if data is None:
                    raise Failure(INCOMPLETE)
                self.seen, self.held = self.seen + len(data), self.held - len(data)
                for line in self.reader.feed(data):
                    added = contents(line)
                    if added is None:
                        self.status = FINISHED
                        yield FINISHED, ""
                        break
                    for x in added:
                        self.size += len(x.encode())
                        if self.size > MAX_ANSWER:
                            raise Failure(LIMIT)
                        self.new.append(x)
                        yield TOKEN, x
                        self.n += 1
        except Failure as e:
            self.status = FAILED
            yield FAILED, str(e)


class AnswerReader(StatefulProcessor):
    """Rows (bucket, stream_id, seq, data) to tokens and one finished or failed row. A row without data ends its stream."""

    def __init__(self, tokens: bool = True):
        self.tokens = tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getListState("heads", "changed binary")
        self.parts = handle.getMapState("parts", "stream_id bigint, k bigint", "text string")
        self.early = handle.getMapState("early", "stream_id bigint, k bigint", "fragments binary")

    def handleInputRows(self, key, rows, timerValues):
        heads: dict[int, tuple] = {}
        length = 0
        for (changed,) in self.heads.get():
            length += len(changed)
            heads |= pickle.loads(bytes(changed))
        met: dict[int, Answer] = {}
        for _, stream, seq, data in rows:
            found = met.get(stream)
            if found is None:
                head = heads.get(stream, Answer.NEW)
                found = met[stream] = Answer(head, (bytes(self.early.getValue((stream, k))[0]) for k in range(head[4])))
            for kind, text in found.feed(seq, None if data is None else bytes(data)):
                if kind == FINISHED:
                    before = [self.parts.getValue((stream, k))[0] for k in range(found.parts)]
                    text = "".join([*before, found.text, *found.new])
                if kind != TOKEN or self.tokens:
                    yield Row(stream_id=stream, n=found.n, kind=kind, text=text)
        new = {stream: self._saved(stream, found) for stream, found in met.items() if found.was_open}
        if new:
            changed, whole = pickle.dumps(new), pickle.dumps(heads | new)
            if length + len(changed) > 2 * len(whole):
                self.heads.put([(whole,)])
            else:
                self.heads.appendValue((changed,))

    def _saved(self, stream: int, found: Answer) -> tuple:
        """What to keep of a stream, when entries of its own are written or deleted."""
        done = found.status != OPEN
        left = found.early.keys() & found.in_entries
        if done or 2 * len(left) <= found.listed:  # most of the entries' fragments are read, so these go; what is left is written again
            for k in range(found.blobs):
                self.early.removeKey((stream, k))
            found.blobs, found.listed, left = 0, 0, set()
        if done:
            for k in range(found.parts):
                self.parts.removeKey((stream, k))
            return (found.status, *Answer.NEW[1:])
        early = {seq: data for seq, data in found.early.items() if seq not in left}
        if sum(len(d or b"") for d in early.values()) > SMALL:
            self.early.updateValue((stream, found.blobs), (pickle.dumps(early),))
            found.blobs, found.listed, early = found.blobs + 1, found.listed + len(early), {}
        text = "".join([found.text, *found.new])
        if len(text.encode()) > SMALL:
            self.parts.updateValue((stream, found.parts), (text,))
            found.parts, text = found.parts + 1, ""
        return (OPEN, found.following, found.seen, len(found.early), found.blobs, found.listed, found.parts, found.size, found.n, b"".join(found.reader.pieces), early, text)

    def close(self) -> None:
        pass


def fragment_events(fragments: DataFrame, tokens: bool = True) -> DataFrame:
    """A stream of fragments (stream_id, seq, data) as tokens in order (unless tokens is false), and one row when an answer
    finishes or fails (with its reason). What comes after that is passed over. A stream's state is bounded by MAX_STREAM."""
    stream = F.col("stream_id").cast("long")
    rows = fragments.select(F.shiftright(stream, BUCKET_BITS).alias("bucket"), stream.alias("stream_id"), F.col("seq").cast("long"), F.col("data").cast("binary"))
    return rows.groupBy("bucket").transformWithState(AnswerReader(tokens), EVENTS, "append", "none")


def answer_events(lines: DataFrame, tokens: bool = True) -> DataFrame:
    """The same for whole event lines (stream_id, seq, line)."""
    return fragment_events(lines.select("stream_id", "seq", F.concat("line", F.lit("\n")).cast("binary").alias("data")), tokens)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The store that states of several parts need, for the queries started inside; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_once(spark: SparkSession, events: DataFrame, path: str | None = None) -> DataFrame:
    """Runs a stream of events over all there is and returns the rows written, from earlier runs at the same path too;
    the sink's log and the checkpoint there make it exactly once."""
    out = path or tables.work_dir(spark, "answers")
    with state_store(spark):
        query = events.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{out}/rows")


def committed_once(spark: SparkSession, lines: DataFrame, path: str | None = None) -> DataFrame:
    """stream_id and answer of the streams of lines that finished."""
    done = answer_events(lines, tokens=False).where(F.col("kind") == FINISHED).select("stream_id", F.col("text").alias("answer"))
    return run_once(spark, done, path)
