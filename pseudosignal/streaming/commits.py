"""Streams whose micro-batches become visible as a whole, and once.

A batch may write several tables. Each goes to a folder of its own attempt, and only when all
are complete one small file enters the batch, its folders and the state after it into the commit
table. That single file is what makes the batch visible: readers look up the commits and
open the folders they name, so a batch that died half-way, or is being repeated, shows nothing.
A batch whose commit is there is not run again, for instance when the stream stopped between
this commit and its own checkpoint. State that later batches need (a watermark, queue depths,
counters) is part of the commit and so counts exactly once too.

Compaction rewrites the batches since the last one as one folder for each table and commits
the range; a wider range hides the batches in it. So there are never more live entries than
compactions and the batches since the last, and readers see either the batches or their sum.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pseudosignal.sources.files import remove, subfolders
from pseudosignal.sources.sinks import with_bucket_date

COMMITS = "commits"
_SCHEMA = (
    "query string, first_batch bigint, last_batch bigint, attempt string, by_day boolean,"
    " tables map<string,string>, state string"
)
# Tables with these columns are laid out by them when compacted.
DAY_LAYOUT = ("institution_id", "bucket_date")
# Tables whose name ends so are whole in every batch: only the last one counts.
LAST_ONLY = "-now"
EVERY_MINUTE = {"processingTime": "1 minute"}


@dataclass(frozen=True)
class Commit:
    """Batches ``first_batch`` to ``last_batch`` of a query. ``tables`` has the schema of each."""

    query: str
    first_batch: int
    last_batch: int
    attempt: str
    by_day: bool
    tables: dict[str, str]
    state: dict = field(default_factory=dict)

    def folder(self, out: str, table: str) -> str:
        return f"{out.rstrip('/')}/{table}/{self.attempt}"

    def schema(self, table: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.tables[table]))


def _covers(wide: Commit, narrow: Commit) -> bool:
    return wide.first_batch <= narrow.first_batch and narrow.last_batch <= wide.last_batch


def live_commits(spark: SparkSession, out: str) -> list[Commit]:
    """What counts now, by query and batch. One small row for each batch since a compaction."""
    try:
        found = (
            spark.read.schema(_SCHEMA)
            .option("recursiveFileLookup", "true")
            .json(f"{out.rstrip('/')}/{COMMITS}")
            .collect()
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    rows = [Commit(**{**r.asDict(), "state": json.loads(r["state"])}) for r in found]
    rows.sort(key=lambda c: (c.query, c.first_batch, -c.last_batch, c.attempt))
    live: list[Commit] = []
    for row in rows:
        if not live or live[-1].query != row.query or not _covers(live[-1], row):
            live.append(row)
    return live


def _enter(spark: SparkSession, out: str, commit: Commit) -> None:
    row = (
        commit.query, commit.first_batch, commit.last_batch, commit.attempt, commit.by_day,
        commit.tables, json.dumps(commit.state),
    )
    # A folder of its own: a committer clears what other writers of the same folder prepare.
    place = f"{out.rstrip('/')}/{COMMITS}/{commit.attempt}"
    spark.createDataFrame([row], _SCHEMA).coalesce(1).write.json(place)


class Batch:
    """What a job sees of its micro-batch: the rows, the commit before it, and ``save``."""

    def __init__(self, rows: DataFrame, number: int, out: str, before: Commit | None):
        self.rows, self.number, self.before = rows, number, before
        self._out, self.attempt = out, uuid.uuid4().hex
        self.tables: dict[str, str] = {}

    @property
    def state(self) -> dict:
        """State that the batch before left."""
        return {} if self.before is None else dict(self.before.state)

    def save(self, table: str, df: DataFrame) -> DataFrame:
        """Write a table of this batch; the rows as they were written."""
        path = f"{self._out.rstrip('/')}/{table}/{self.attempt}"
        df.write.parquet(path)
        self.tables[table] = df.schema.json()
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def previous(self, table: str) -> DataFrame | None:
        """A table that the last commit saved, if it did."""
        if self.before is None or table not in self.before.tables:
            return None
        schema = self.before.schema(table)
        path = self.before.folder(self._out, table)
        return self.rows.sparkSession.read.schema(schema).parquet(path).select(*schema.names)


def start_committed(
    frame: DataFrame,
    out: str,
    checkpoint: str,
    job: Callable[[Batch], dict | None],
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run ``job`` on every micro-batch and commit what it saved, with the state it returns.

    A query is named by its checkpoint. One with a new checkpoint is a new query: it adds to the
    output, so reading old input with a new checkpoint counts that input twice.
    """
    started, own = threading.Event(), {}

    def run(rows: DataFrame, number: int) -> None:
        started.wait()
        spark = rows.sparkSession
        # Looked up anew, for a compaction may have replaced it.
        mine = [c for c in live_commits(spark, out) if c.query == own["query"]]
        before = mine[-1] if mine else None
        if before is not None and number <= before.last_batch:
            return
        batch = Batch(rows, number, out, before)
        state = job(batch) or {}
        _enter(
            spark,
            out,
            Commit(own["query"], number, number, batch.attempt, False, batch.tables, state),
        )

    query = (
        frame.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_MINUTE))
        .start()
    )
    own["query"] = query.id
    started.set()
    return query


def _read(spark: SparkSession, out: str, commits: list[Commit], table: str) -> DataFrame:
    """Rows of a table in some commits: one scan for each schema and layout."""
    groups: dict[tuple, list[Commit]] = {}
    for commit in commits:
        groups.setdefault((commit.tables[table], commit.by_day), []).append(commit)
    parts = []
    for members in groups.values():
        schema = members[0].schema(table)
        folders = [c.folder(out, table) for c in members]
        parts.append(spark.read.schema(schema).parquet(*folders).select(*schema.names))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def read_committed(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A table as the commits have it now. Raises ValueError where no commit has that table."""
    commits = [c for c in live_commits(spark, out) if table in c.tables]
    if not commits:
        raise ValueError(f"no batch with a table {table} is committed in {out}")
    return _read(spark, out, commits, table)


def last_states(spark: SparkSession, out: str) -> dict[str, dict]:
    """The state after the last committed batch of each query."""
    return {c.query: c.state for c in live_commits(spark, out)}


def compact(spark: SparkSession, out: str, least: int = 2, period: str = "day") -> int:
    """Rewrite the batches since the last compaction as one folder for each table; their number.

    Signals are laid out by institution and day (or month, or year: ``period``); of a table that
    every batch saves whole only the last one is kept. The stream may go on meanwhile.
    """
    total = 0
    by_query: dict[str, list[Commit]] = {}
    for commit in live_commits(spark, out):
        if commit.first_batch == commit.last_batch and not commit.by_day:
            by_query.setdefault(commit.query, []).append(commit)
    for query, batches in by_query.items():
        if len(batches) < least:
            continue
        attempt, tables = uuid.uuid4().hex, {}
        for table in sorted({t for c in batches for t in c.tables}):
            if table.endswith(LAST_ONLY):
                holders = batches[-1:]
            else:
                holders = [c for c in batches if table in c.tables]
            if table not in holders[-1].tables:
                continue
            rows = _read(spark, out, holders, table)
            tables[table] = rows.schema.json()
            path = f"{out.rstrip('/')}/{table}/{attempt}"
            if {"institution_id", "timestamp"} <= set(rows.columns):
                dated = with_bucket_date(rows, period).hint("rebalance", *DAY_LAYOUT)
                dated.write.partitionBy(*DAY_LAYOUT).parquet(path)
            else:
                rows.hint("rebalance").write.parquet(path)
        first, last = batches[0].first_batch, batches[-1]
        _enter(spark, out, Commit(query, first, last.last_batch, attempt, True, tables, last.state))
        total += len(batches)
    return total


def read_last(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A table that every batch saves whole, as the last batch of each query left it."""
    last = {c.query: c for c in live_commits(spark, out) if table in c.tables}
    if not last:
        raise ValueError(f"no batch with a table {table} is committed in {out}")
    return _read(spark, out, list(last.values()), table)


def clean(spark: SparkSession, out: str, hours: float = 24.0) -> list[str]:
    """Delete folders that no commit names and that are older than ``hours``: attempts that died,
    and batches that a compaction replaced. Readers that began before must be done by then."""
    live = live_commits(spark, out)
    tables, attempts = {t for c in live for t in c.tables}, {c.attempt for c in live}
    gone = [
        f"{out.rstrip('/')}/{table}/{name}"
        for table in sorted(tables | {COMMITS})
        for name, age in subfolders(spark, f"{out.rstrip('/')}/{table}").items()
        if name not in attempts and age >= hours
    ]
    remove(spark, *gone)
    return gone
