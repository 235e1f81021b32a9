"""Batches of an archive: written aside, and valid once they are committed.

Every write of a batch goes to folders of its own, ``batch_id=../generation=..``, below
each table. One entry in the log then makes them the batch's content, all tables at once;
whatever the batch had before, and what a crashed write left, is no longer read. A batch
that is written again with other rows, or with none, is thereby replaced.

Writers do not lock each other out. A batch is made from the state of the log when it began;
if others have committed since, it is checked against them before it is committed, and refused
(``Conflict``) if it clashes: then it is made once more from the new state.

The log is a folder of small files, one per commit, numbered; a number can be taken once.
After ``CHECKPOINT_EVERY`` commits the state is written as a file of its own and what it sums up
is deleted. Small batches of like size are merged, so that their number stays small.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Collection, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, list_names, read_text, write_new

LOG = "commits"
COMMIT, CHECKPOINT = ".commit", ".checkpoint"
CHECKPOINT_EVERY = 20
FANOUT = 4  # so many batches of like size are merged
COMPRESSION = "zstd"
RETRIES = 10


class Conflict(RuntimeError):
    """Another batch was committed meanwhile, and the two cannot both stand."""


@dataclass(frozen=True)
class Table:
    """What a batch has of a table: the schema, and by what its folders are divided."""

    schema: str
    partition_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Commit:
    seq: int
    batch_id: int
    generation: str
    rows: int
    last_id: int
    tables: dict[str, Table] = field(default_factory=dict)


@dataclass(frozen=True)
class State:
    """The log up to one number: the valid commit of each batch, the largest id that was ever
    given, and the ranges of batches that were merged and are closed."""

    seq: int = 0
    last_id: int = 0
    valid: dict[int, Commit] = field(default_factory=dict)
    closed: tuple[tuple[int, int], ...] = ()

    def is_closed(self, batch_id: int) -> bool:
        return any(first <= batch_id <= last for first, last in self.closed)

    def after(self, entry: dict) -> "State":
        done = _commit(entry["commit"])
        gone = set(entry["replaces"])
        valid = {b: c for b, c in self.valid.items() if b not in gone} | {done.batch_id: done}
        closed = _ranges(self.closed, entry["closes"])
        return State(done.seq, max(self.last_id, done.last_id), valid, closed)


def _commit(entry: dict) -> Commit:
    tables = {name: Table(t["schema"], tuple(t["partition_by"])) for name, t in entry["tables"].items()}
    return Commit(**{**entry, "tables": tables})


def _ranges(ranges: Collection[tuple[int, int]], more: Collection[int]) -> tuple[tuple[int, int], ...]:
    """Ranges of whole numbers with some more numbers, joined where they touch."""
    out: list[list[int]] = []
    for first, last in sorted([*(tuple(r) for r in ranges), *((b, b) for b in more)]):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return tuple((a, b) for a, b in out)


Rewrite = Callable[[DataFrame, int, str], Mapping[str, Table]]


@dataclass(frozen=True)
class Generations:
    spark: SparkSession
    root: str

    # -- the log ----------------------------------------------------------------

    def state(self) -> State:
        """The state now. A few small files are read by the driver."""
        for _ in range(RETRIES):
            state = self._read_log()
            if state is not None:
                return state
        raise RuntimeError(f"{self.root}/{LOG} changes faster than it can be read")

    def _read_log(self) -> State | None:
        names = list_names(self.spark, f"{self.root}/{LOG}")
        summed = [n for n in names if n.endswith(CHECKPOINT)]
        state = State()
        if summed:
            text = read_text(self.spark, f"{self.root}/{LOG}/{summed[-1]}")
            if text is None:  # a newer one took its place
                return None
            known = json.loads(text)
            valid = {c["batch_id"]: _commit(c) for c in known["valid"]}
            state = State(known["seq"], known["last_id"], valid, _ranges(known["closed"], ()))
        for name in names:
            if name.endswith(COMMIT) and int(name.removesuffix(COMMIT)) > state.seq:
                text = read_text(self.spark, f"{self.root}/{LOG}/{name}")
                if text is None:
                    return None
                state = state.after(json.loads(text))
        return state

    def _publish(self, seq: int, entry: dict) -> bool:
        return write_new(self.spark, f"{self.root}/{LOG}/{seq:020d}{COMMIT}", json.dumps(entry))

    def checkpoint(self) -> None:
        """Sum the log up in one file. What it replaces is deleted afterwards; a reader that
        misses a file looks again."""
        state = self.state()
        known = {"seq": state.seq, "last_id": state.last_id, "closed": state.closed,
                 "valid": [asdict(c) for c in state.valid.values()]}
        write_new(self.spark, f"{self.root}/{LOG}/{state.seq:020d}{CHECKPOINT}", json.dumps(known))
        for name in list_names(self.spark, f"{self.root}/{LOG}"):
            number, _, kind = name.partition(".")
            if number.isdigit() and (int(number) < state.seq or (int(number) == state.seq and f".{kind}" == COMMIT)):
                delete_path(self.spark, f"{self.root}/{LOG}/{name}")

    # -- writing a batch ----------------------------------------------------------

    def new(self, batch_id: int, state: State) -> str:
        """A generation to write the batch to."""
        if state.is_closed(batch_id):
            raise ValueError(f"batch {batch_id} was merged with others and cannot be written again")
        return uuid.uuid4().hex

    def path(self, table: str, batch_id: int, generation: str) -> str:
        return f"{self.root}/{table}/batch_id={batch_id}/generation={generation}"

    def write(
        self,
        rows: DataFrame,
        table: str,
        batch_id: int,
        generation: str,
        partition_by: tuple[str, ...] = (),
        options: Mapping[str, str] | None = None,
    ) -> Table:
        options = {"compression": COMPRESSION, **(options or {})}
        writer = rows.write.mode("overwrite").options(**options).partitionBy(*partition_by)
        writer.parquet(self.path(table, batch_id, generation))
        return Table(rows._jdf.schema().toDDL(), partition_by)

    def commit(
        self,
        generation: str,
        batch_id: int,
        tables: Mapping[str, Table],
        state: State,
        rows: int = 0,
        last_id: int = 0,
        replaces: Collection[int] = (),
        check: Callable[[list[Commit], State], None] | None = None,
    ) -> None:
        """Make a generation, with the tables it has, the content of its batch; the batches that it
        ``replaces`` besides end and are closed, as is the batch itself then.

        ``state`` is what the generation was made from. If others have committed since, none of
        them may be one of these batches, and ``check`` may refuse them.
        """
        own = {batch_id, *replaces}
        merged = sorted(own) if replaces else []
        now = self.state()
        while True:
            later = [c for c in now.valid.values() if c.seq > state.seq]
            if any(c.batch_id in own for c in later) or any(now.is_closed(b) and not state.is_closed(b) for b in own):
                raise Conflict(f"batch {batch_id} was written by another job meanwhile")
            if later and check:
                check(later, now)
            done = Commit(now.seq + 1, batch_id, generation, rows, max(last_id, state.last_id), dict(tables))
            if self._publish(done.seq, {"commit": asdict(done), "replaces": sorted(own), "closes": merged}):
                break
            now = self.state()
        if done.seq % CHECKPOINT_EVERY == 0:
            self.checkpoint()

    # -- reading ------------------------------------------------------------------

    def read(
        self,
        table: str,
        schema: str,
        only: Collection[int] | None = None,
        without: int | None = None,
        state: State | None = None,
    ) -> DataFrame:
        """The committed rows of a table, of all batches, some, or all but one. Who reads several
        tables passes the state they are to be read at."""
        state = self.state() if state is None else state
        paths = [
            self.path(table, c.batch_id, c.generation)
            for c in state.valid.values()
            if table in c.tables and c.batch_id != without and (only is None or c.batch_id in only)
        ]
        full = f"{schema}, batch_id bigint, generation string"
        if not paths:
            return self.spark.createDataFrame([], full).drop("generation")
        reader = self.spark.read.schema(full).option("basePath", f"{self.root}/{table}")
        return reader.parquet(*paths).drop("generation")

    # -- upkeep --------------------------------------------------------------------

    def merge(self, batch_ids: Collection[int], rewrite: Mapping[str, Rewrite] | None = None) -> None:
        """Rewrite several batches as one, with every table that any of them has. They cannot be
        written again afterwards.

        ``rewrite`` has, by table, what writes it and says which tables it wrote, for tables whose
        files have an order or that others are derived from; the others are written as they come.
        """
        state = self.state()
        chosen = sorted(set(batch_ids))
        unknown = sorted(set(chosen) - state.valid.keys())
        if unknown or len(chosen) < 2:
            raise ValueError(f"two or more committed batches are needed; not committed: {unknown}")
        owner, generation = chosen[-1], uuid.uuid4().hex
        known: dict[str, Table] = {}
        for b in chosen:  # of a table that changed, the last batch says what it looks like
            known |= state.valid[b].tables
        tables: dict[str, Table] = {}
        for name in sorted(known, key=lambda n: n not in (rewrite or {})):
            if name in tables:
                continue
            rows = self.read(name, known[name].schema, only=chosen, state=state).drop("batch_id")
            if name in (rewrite or {}):
                tables |= rewrite[name](rows, owner, generation)
            else:
                by = known[name].partition_by
                tables[name] = self.write(rows.hint("rebalance", *by), name, owner, generation, by)
        rows = sum(state.valid[b].rows for b in chosen)
        last = max(state.valid[b].last_id for b in chosen)
        self.commit(generation, owner, tables, state, rows, last, replaces=chosen[:-1])

    def compact(
        self, keep: Collection[int] = (), rewrite: Mapping[str, Rewrite] | None = None, fanout: int = FANOUT
    ) -> int:
        """Merge batches of like size, ``fanout`` at a time and the small ones first, until there are
        fewer than that of any size; how many merges it took. What merged batches are merged into
        again is written once, so a row is rewritten at most once here, and as often as the logarithm
        of the archive in all. Batches to ``keep`` stay open."""
        done = 0
        while True:
            rows = {c.batch_id: c.rows for c in self.state().valid.values() if c.batch_id not in keep}
            groups = [group for group in merged_groups(rows, fanout) if len(group) > 1]
            if not groups:
                return done
            for group in groups:
                self.merge(group, rewrite)
                done += 1

    def vacuum(self, older_than: float = 0) -> None:
        """Delete what no commit refers to, if it was last changed so many seconds ago: what is
        younger may be a batch that is being written, or a state that is being read."""
        valid = {c.generation for c in self.state().valid.values()}
        latest = (time.time() - older_than) * 1000
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for depth in ("*", "*/*"):  # tables are folders, or folders of folders
            pattern = hadoop.Path(f"{self.root}/{depth}/batch_id=*/generation=*")
            found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
            for status in found or ():
                unused = status.getPath().getName().removeprefix("generation=") not in valid
                if unused and status.getModificationTime() <= latest:
                    delete_path(self.spark, status.getPath().toString())


def merged_groups(rows: Mapping[int, int], fanout: int) -> list[list[int]]:
    """Which batches end up in one, from the rows of each: ``fanout`` of like size are merged, the
    small ones first, and what they give counts as one of its size."""
    groups = {batch_id: [batch_id] for batch_id in rows}
    rows = dict(rows)
    while True:
        sizes: dict[int, list[int]] = defaultdict(list)
        for batch_id, n in rows.items():
            sizes[int(math.log(n + 1, fanout))].append(batch_id)
        full = [sorted(sizes[tier])[:fanout] for tier in sorted(sizes) if len(sizes[tier]) >= fanout]
        if not full:
            return [sorted(group) for group in groups.values()]
        owner = full[0][-1]
        groups[owner] = [b for batch_id in full[0] for b in groups.pop(batch_id)]
        rows[owner] = sum(rows.pop(batch_id) for batch_id in full[0])


def counted(rows: DataFrame, column: str) -> tuple[int, int]:
    """How many rows, and the largest value of a column (0 if there is none)."""
    found = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(column), F.lit(0))).first()
    return found[0], found[1]
