"""Error blocks of logs that grow: state between micro-batches instead of whole files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, DateType, DecimalType, IntegralType, StringType

from ..functions.text import NO_CAUSE
from ..operators.logs import STARTS

#: Spark's settings for a run over what is there: the store that timers need, and no batches without data, as these would follow each other without end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: What is kept of a log between batches, and what is given of a block.
STATE = "blocks long, last long, open boolean, first long, end long, n_lines long, cause string, waiting boolean, trace string"
FOUND = "block_id long, first_line long, last_line long, n_lines long, root_cause string, trace string"
#: Types that name files: their values are the same in pandas and in the state.
NAMES = (StringType, BinaryType, IntegralType, DecimalType, DateType, BooleanType)

_START = re.compile(STARTS)
_MARKED = re.compile(r"Caused by:\s+(\S[^\n]*)", re.ASCII)
_WAITING = re.compile(r"Caused by:\s*$", re.ASCII)
_EMPTY = re.compile(r"Caused by:\s+$", re.ASCII)


@dataclass
class OpenBlock:
    """What is known of a log so far: its blocks, its last line, and the block that is open."""

    blocks: int = 0
    last: int | None = None
    open: bool = False
    first: int | None = None
    end: int | None = None
    n_lines: int = 0
    cause: str | None = None
    waiting: bool = False
    trace: str = ""

    def feed(self, number: int, line: str, most: int) -> Iterator[tuple]:
        """Take one line; a block that it closes is given."""
        if self.last is not None and number <= self.last:
            return
        self.last = number
        if _START.search(line):
            yield from self.close()
            self.blocks, self.open, self.first = self.blocks + 1, True, number
        if not self.open:
            return
        self.trace = (self.trace + "\n" + line if self.n_lines else line)[:most]
        self.end, self.n_lines = number, self.n_lines + 1
        marked = _MARKED.search(line)
        if marked:
            self.cause = marked[1]
        elif _EMPTY.search(line):
            self.cause = ""
        elif self.waiting and not _WAITING.search(line):
            self.cause = line.lstrip(" \t\n\r\f\v")
        if line.strip(" \t\n\r\f\v"):
            self.waiting = not marked and bool(_WAITING.search(line))
        if not line.strip(" "):
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.open:
            yield self.blocks, self.first, self.end, self.n_lines, NO_CAUSE if self.cause is None else self.cause, self.trace
        self.open, self.first, self.end, self.n_lines, self.cause, self.waiting, self.trace = False, None, None, 0, None, False, ""


class BlockProcessor(StatefulProcessor):
    """Closed blocks of the logs of one part; open blocks are kept from batch to batch, and given when no line comes for ``wait`` seconds.

    A part's states are read and written as one list, so that what a call costs is
    shared by all of its files.
    """

    def __init__(self, file: str, kind: str, most: int, wait: float):
        self.names, self.kind, self.most, self.wait = [file, "block_id", "first_line", "last_line", "n_lines", "root_cause", "trace"], kind, most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getListState("blocks", f"name {self.kind}, due long, {STATE}")

    def load(self) -> dict[object, tuple[int | None, OpenBlock]]:
        return {name: (due, OpenBlock(*kept)) for name, due, *kept in self.state.get()} if self.state.exists() else {}

    def keep(self, blocks: dict[object, tuple[int | None, OpenBlock]]) -> None:
        """Write the part's blocks, and wait for the first that is due."""
        self.state.put([(name, due, *astuple(block)) for name, (due, block) in blocks.items()])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        first = min((due for due, _ in blocks.values() if due is not None), default=None)
        if first is not None:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        blocks, lines, found = self.load(), {}, []
        for new in rows:
            for name, named, number, line in zip(*(new[c].tolist() for c in ("name", "named", "line_no", "line")), strict=True):
                lines.setdefault(name if named else None, []).append((number, line))
        due = int(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.wait)
        for name, of_file in lines.items():
            block = blocks[name][1] if name in blocks else OpenBlock()
            for number, line in sorted(of_file, key=lambda r: r[0]):
                found += [(name, *b) for b in (block.feed(number, line, self.most) if isinstance(line, str) else block.close())]
            blocks[name] = due if block.open else None, block
        self.keep(blocks)
        yield pd.DataFrame(found, columns=self.names, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, blocks, found = expiredTimerInfo.getExpiryTimeInMs(), self.load(), []
        for name, (due, block) in blocks.items():
            if due is not None and due <= now:
                found += [(name, *b) for b in block.close()]
                blocks[name] = None, block
        self.keep(blocks)
        yield pd.DataFrame(found, columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def block_stream(lines: DataFrame, file: str = "file", most: int = 5000, wait: float = 3600.0, parts: int = 1024) -> DataFrame:
    """(file, block_id, first_line, last_line, n_lines, root_cause, trace) of each block as soon as it is closed.

    ``lines`` is a stream of (file, line_no long, line) whose lines come in the
    order of their file from batch to batch; within a batch they may be mixed.  A
    null line says that the file is complete; other lines without a number are left
    out.  Files are named by strings, bytes, whole or decimal numbers, dates or
    booleans; null is a name.  Lines at or before the last one seen are repeats and
    count for nothing.  A block closed by waiting ``wait`` seconds is given as it
    then is; what follows it starts with the next block.  Blocks are numbered as
    ``error_blocks`` does.

    State per file is a few numbers and the first ``most`` characters of its open
    block.  Files are dealt by hash to ``parts`` keys of state, so a batch costs one
    call per part with lines, not one per file; the states of such a part are read
    and written whole.  A checkpoint holds for one number of parts only.
    """
    kind = lines.schema[file].dataType
    if not isinstance(kind, NAMES):
        raise TypeError(f"files are named by {kind.simpleString()}: cast them to strings")
    name = F.col(f"`{file}`")
    # pandas would make whole numbers with a null among them floating ones.
    given = F.coalesce(name, F.lit(0).cast(kind)) if isinstance(kind, IntegralType) else name
    dealt = lines.where(F.col("line_no").isNotNull() | F.col("line").isNull()).select(
        given.alias("name"), name.isNotNull().alias("named"), F.coalesce(F.col("line_no").cast("long"), F.lit((1 << 63) - 1)).alias("line_no"), "line",
        F.pmod(F.xxhash64(name), F.lit(parts)).alias("part"),
    )
    return dealt.groupBy("part").transformWithStateInPandas(
        BlockProcessor(file, kind.simpleString(), most, wait), outputStructType=f"`{file}` {kind.simpleString()}, {FOUND}", outputMode="Append", timeMode="ProcessingTime",
    )


def append_blocks(lines: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Take what is there of the stream ``lines`` and append the blocks that it closes to a Parquet table."""
    conf = lines.sparkSession.conf
    before = {name: conf.get(name) for name in SETTINGS}
    try:
        for name, value in SETTINGS.items():
            conf.set(name, value)
        stream = block_stream(lines, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            conf.set(name, value)
