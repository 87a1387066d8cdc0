"""Actions, run records, the metrics directory, and runs in the background."""

from __future__ import annotations

import datetime as dt
import hashlib
import resource
import threading
import time
import uuid
from concurrent.futures import Future
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.locus import SplitPoints
from ..operators import combine
from ..operators.replay import Grid, replay, shadow_series
from ..operators.throughput import ProbeSettings, Series, decide, would_stop
from ..sources import sinks
from ..sources.annotation import annotated
from ..sources.dataset import Dataset, packed_scans
from ..sources.files import Files, compression_options
from .ordering import OrderedFrame, OrderingAssertionFailed, RowOrdering

#: Columns of the run record table, in order. Fixed values.
RECORD = (
    "run_id string, status string, started_at timestamp, formulation string, groups bigint, split_points string, row_ordering string,"
    " dataset_path string, input_format string, output_format string, compression string, threads bigint, input_tables bigint, samples bigint,"
    " output_path string, rows_written bigint, run_ns bigint, execute_ns bigint, peak_rss_bytes bigint, action string, stop_reason string,"
    " steady_state_throughput double, relative_half_width double, warmup_end_ns bigint, window_end_ns bigint, window_rows bigint,"
    " first_partition_end_ns bigint, poll_period_ns bigint, batch_duration_ns bigint, precision double, consecutive_checks bigint,"
    " window_groups bigint, min_duration_ns bigint, max_duration_ns bigint, would_stop_ns bigint, would_be_steady_state_throughput double,"
    " would_be_relative_half_width double, would_be_warmup_end_ns bigint"
)
METRICS = "run_id string, node bigint, parent bigint, depth bigint, operator string, display string, partition bigint, metric string, value bigint"
PROGRESS = "run_id string, sample_index bigint, elapsed_ns bigint, rows bigint"
SETTINGS = {"threads": None, "target_partitions": "spark.sql.shuffle.partitions", "repartition_file_min_size": "spark.sql.files.maxPartitionBytes"}


class RunError(RuntimeError):
    """A failed run; `code` tells callers how."""

    code = "backend_error"


class InvalidAction(RunError):
    code = "invalid_action"


class RunCancelled(RunError):
    code = "run_cancelled"


def error_code(error: BaseException) -> str:
    return "ordering_assertion_failed" if isinstance(error, OrderingAssertionFailed) else getattr(error, "code", "backend_error")


@dataclass(frozen=True)
class Formulation:
    """How a combiner's plan is built: union, grouped-merge, interval-merge (references) or alleles."""

    name: str = "union"
    groups: int | None = None
    points: SplitPoints | None = None

    def __post_init__(self) -> None:
        if self.name not in ("union", "grouped-merge", "interval-merge", "alleles"):
            raise InvalidAction(f"unknown formulation: {self.name}")
        if self.groups is not None and self.name != "grouped-merge":
            raise InvalidAction("groups apply only to the grouped-merge formulation")
        if (self.points is not None) != (self.name == "interval-merge"):
            raise InvalidAction("split points belong to the interval-merge formulation, which requires them")

    def plan(self, dataset: Dataset) -> OrderedFrame:
        frames = dataset.frames()
        order = dataset.sort_columns()
        if self.name == "alleles":
            return combine.combine_alleles(frames, RowOrdering.parse("locus").columns(dataset.columns))
        if self.name == "grouped-merge":
            return combine.combine_grouped(frames, order, self.groups or len(dataset.tables))
        if self.name == "interval-merge":
            return OrderedFrame(combine.union(frames).orderBy(*[F.col(c).asc_nulls_last() for c in order]), tuple(order), "file-per-interval", tuple(self.points))
        return combine.combine_union(frames, order)


@dataclass(frozen=True)
class Write:
    path: str
    fmt: str = "parquet"
    compression: str | None = None
    metrics: str | None = None
    run_id: str | None = None


@dataclass(frozen=True)
class Probe:
    metrics: str
    run_id: str | None = None
    shadow: bool = False
    settings: ProbeSettings = field(default_factory=ProbeSettings)


@dataclass(frozen=True)
class Collect:
    limit: int | None = 20


@dataclass(frozen=True)
class Explain:
    analyze: bool = False


@dataclass(frozen=True)
class Outcome:
    kind: str
    text: str = ""
    rows: int | None = None
    table: object = None
    run_id: str | None = None
    record: dict | None = None


class MetricsDirectory:
    """runs/ metrics/ progress/ checks/ replay-baselines/ replays/: one Parquet file for each run and table."""

    TABLES = ("runs", "metrics", "progress", "checks", "replay-baselines", "replays")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def file(self, table: str, run_id: str) -> str:
        return f"{self.path}/{table}/{run_id}.parquet"

    def has(self, run_id: str) -> bool:
        return self.files.exists(self.file("runs", run_id))

    def read(self, table: str) -> DataFrame | None:
        """One table over all runs; files written before a column existed lack it."""
        folder = f"{self.path}/{table}"
        if not self.files.exists(folder) or not self.files.data_files(folder, ".parquet"):
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*[e.path for e in self.files.data_files(folder, ".parquet")])

    def record(self, record: dict, metrics: DataFrame | None, progress: DataFrame | None = None) -> None:
        """Metrics and progress first, the record last: a run with a record is whole."""
        run_id = record["run_id"]
        if progress is not None:
            sinks.write_one_file(progress, self.file("progress", run_id))
        if metrics is not None:
            sinks.write_one_file(metrics, self.file("metrics", run_id))
        row = self.spark.createDataFrame([tuple(record.get(c.split()[0]) for c in RECORD.split(", "))], RECORD)
        sinks.write_one_file(row, self.file("runs", run_id))

    def _split(self, found: DataFrame, table: str, wanted: list[str]) -> None:
        """Write one file a run, by one job for all runs; a run without rows gets an empty file."""
        staging = f"{self.path}/.{table}-{uuid.uuid4().hex}"
        try:
            found.withColumn("__run", F.md5("run_id")).repartition("__run").write.partitionBy("__run").parquet(staging)
            made = {e.name.partition("=")[2]: e.path for e in self.files.entries(staging) if e.is_dir}
            for run_id in wanted:
                folder = made.get(hashlib.md5(run_id.encode()).hexdigest())
                parts = self.files.data_files(folder, ".parquet") if folder else []
                if len(parts) == 1:
                    self.files.rename(parts[0].path, self.file(table, run_id))
                else:
                    sinks.write_one_file(found.where(F.col("run_id") == run_id), self.file(table, run_id))
        finally:
            self.files.delete(staging)

    def replay(self, grid: Grid | None = None) -> list[str]:
        """Judge every shadow run again, replace its three tables, and remove those of runs that are no shadow runs any more."""
        runs, progress = self.read("runs"), self.read("progress")
        wanted = [] if runs is None or progress is None else [r.run_id for r in runs.where("action = 'shadow'").select("run_id").distinct().orderBy("run_id").collect()]
        names = {"checks": "checks", "replay-baselines": "baselines", "replays": "replays"}
        for table, what in names.items():
            if wanted:
                self._split(replay(shadow_series(runs, progress), what, grid), table, wanted)
            folder = f"{self.path}/{table}"
            if self.files.exists(folder):
                for e in self.files.entries(folder):
                    if e.name.removesuffix(".parquet") not in wanted:
                        self.files.delete(e.path)
        return wanted


def plan_metrics(df: DataFrame, run_id: str) -> list[tuple]:
    """The metrics of an executed frame's physical plan, one row an operator and metric; `partition` stays null, since
    the engine sums metrics over partitions."""
    out: list[tuple] = []

    def walk(node, parent: int | None, depth: int) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), parent, depth)
        if name.endswith("QueryStage"):
            return walk(node.plan(), parent, depth)
        me = len({r[1] for r in out})
        metrics = node.metrics()
        found = [(k, metrics.apply(k).value()) for k in _keys(metrics)]
        display = node.simpleString(25)
        for k, v in sorted(found) or [("none", 0)]:
            out.append((run_id, me, parent, depth, name, display[:500], None, k, v))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), me, depth + 1)

    walk(df._jdf.queryExecution().executedPlan(), None, 0)
    return out


def _keys(scala_map) -> list[str]:
    it = scala_map.keysIterator()
    out = []
    while it.hasNext():
        out.append(it.next())
    return out


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> None:
    """Session settings of a run; exactly the known keys are taken."""
    if unknown := sorted(set(settings) - set(SETTINGS)):
        raise InvalidAction(f"unknown settings: {', '.join(unknown)}")
    for k, v in settings.items():
        if int(v) < 1:
            raise InvalidAction(f"{k} is at least 1")
        if SETTINGS[k]:
            spark.conf.set(SETTINGS[k], str(v))


class CombinerRun:
    """One run of a combiner over a dataset. Everything that can be refused is refused before rows are read."""

    def __init__(self, spark: SparkSession, path: str, ordering: str, formulation: Formulation, action, *, fmt: str = "parquet", inputs: list[str] | None = None, limit: int | None = None, settings: dict[str, str] | None = None):
        self.spark, self.path, self.ordering, self.formulation, self.action = spark, path, ordering, formulation, action
        self.fmt, self.inputs, self.limit, self.settings = fmt, inputs, limit, settings or {}
        self.directory = MetricsDirectory(spark, action.metrics) if getattr(action, "metrics", None) else None
        self.run_id = getattr(action, "run_id", None) or (uuid.uuid4().hex if self.directory else None)

    def check(self) -> None:
        a = self.action
        apply_settings(self.spark, self.settings)
        if isinstance(a, Write):
            compression_options(a.compression)
            if self.formulation.name == "interval-merge":
                sinks.check_directory_path(a.path)
                sinks.check_vacant(self.spark, a.path)
            else:
                sinks.check_file_path(a.path, a.fmt)
            if a.metrics and (a.metrics.rstrip("/") + "/").startswith(a.path.rstrip("/") + "/"):
                raise InvalidAction("the metrics directory lies under the output")
            if a.run_id and not a.metrics:
                raise InvalidAction("a run id needs a metrics directory")
        if isinstance(a, Collect) and a.limit is not None and a.limit < 0:
            raise InvalidAction("a limit is not negative")
        if self.directory and self.directory.has(self.run_id):
            raise InvalidAction(f"the run id {self.run_id} is taken")

    def execute(self) -> Outcome:
        began = time.monotonic_ns()
        self.check()
        dataset = Dataset.discover(self.spark, self.path, self.ordering, self.fmt)
        if self.inputs is not None:
            dataset = dataset.restrict_to(self.inputs)
        frame = self.formulation.plan(dataset)
        if self.limit is not None:
            frame = frame.limit(self.limit)
        a = self.action
        if isinstance(a, Explain):
            return Outcome("plan", explained(frame.df, a.analyze))
        if isinstance(a, Collect):
            table = sinks.collected(frame, a.limit)
            return Outcome("rows", table=table, rows=table.num_rows)
        started, executing = dt.datetime.now(dt.timezone.utc), time.monotonic_ns()
        record = {
            "run_id": self.run_id, "status": "failed", "started_at": started, "formulation": self.formulation.name, "groups": self.formulation.groups,
            "split_points": str(self.formulation.points) if self.formulation.points else None, "row_ordering": str(dataset.ordering), "dataset_path": self.path,
            "input_format": self.fmt, "threads": self.spark.sparkContext.defaultParallelism, "input_tables": len(dataset.tables), "samples": len(dataset.samples), "rows_written": 0,
        }
        progress = None
        try:
            if isinstance(a, Write):
                record |= {"output_format": a.fmt, "compression": a.compression, "output_path": a.path}
                written: list = []

                def write() -> None:
                    with packed_scans(self.spark):
                        if frame.layout == "file-per-interval":
                            written.append(sinks.write_intervals(frame.df, SplitPoints(frame.points), list(frame.ordering), a.path, a.fmt, a.compression))
                        else:
                            written.append(sinks.write_file(frame, a.path, a.fmt, a.compression))

                if self.formulation.name == "alleles":
                    write()
                else:
                    annotated(self.spark, a.path, dataset.samples, write, a.fmt)
                record["rows_written"] = written[0].rows
            else:
                facts, progress = probed(frame.df, a, self.run_id)
                record |= facts
            record["status"] = "completed"
        except BaseException as error:
            record["status"] = "cancelled" if isinstance(error, (KeyboardInterrupt, RunCancelled)) or "cancelled" in str(error).lower() else "failed"
            raise
        finally:
            record["run_ns"], record["execute_ns"] = time.monotonic_ns() - began, time.monotonic_ns() - executing
            record["peak_rss_bytes"] = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
            if self.directory:
                metrics = self.spark.createDataFrame(plan_metrics(frame.df, self.run_id), METRICS) if record["status"] == "completed" else None
                self.directory.record(record, metrics, progress)
        return Outcome("measured-write" if self.directory and isinstance(a, Write) else "write" if isinstance(a, Write) else "probe", rows=record["rows_written"], run_id=self.run_id, record=record)


def explained(df: DataFrame, analyze: bool = False) -> str:
    """The plan; analyzed, it has run and shows its metrics."""
    if not analyze:
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    df._jdf.queryExecution().toRdd().count()
    rows = [T.Row(depth=r[3], operator=r[4], metric=r[7], value=r[8]) for r in plan_metrics(df, "")]
    return "\n".join(f"{'  ' * r.depth}{r.operator} {r.metric}={r.value}" for r in rows)


def probed(df: DataFrame, action: Probe, run_id: str) -> tuple[dict, DataFrame]:
    """Run a plan in the background and sample the rows of its completed tasks; stop it when the rule says so.

    The engine reports counts as tasks end, so samples are as fine as tasks are; a shadow probe only notes when the rule
    would have stopped.
    """
    spark, settings = df.sparkSession, action.settings
    # A filter that keeps everything and that the optimizer can't drop: its count of output rows is what gets sampled.
    executed = df.where(F.monotonically_increasing_id() > -1)._jdf.queryExecution()
    run = BackgroundRun(spark, lambda: executed.toRdd().count(), run_id)
    samples: list[tuple[int, int]] = []
    began = time.monotonic_ns()
    decision = would = None
    run.start()
    while not run.done():
        time.sleep(settings.poll_period_ns / 1e9)
        samples.append((time.monotonic_ns() - began, _rows_so_far(executed.executedPlan())))
        series = Series.of(samples)
        if action.shadow:
            would = would or would_stop(settings, series)
        else:
            decision = decide(settings, series)
            if decision:
                run.cancel()
                break
    try:
        run.wait()
    except RunError:
        if decision is None:
            raise
    samples.append((time.monotonic_ns() - began, _rows_so_far(executed.executedPlan())))
    end = samples[-1][0]
    decision = decision or decide(settings, Series.of(samples), end)
    facts = {
        "action": "shadow" if action.shadow else "probe", "stop_reason": decision.stop_reason, "steady_state_throughput": decision.steady_state_throughput,
        "relative_half_width": decision.relative_half_width, "warmup_end_ns": decision.warmup_end_ns, "window_end_ns": decision.window_end_ns, "window_rows": decision.window_rows,
        "first_partition_end_ns": end if decision.stop_reason == "completed" else None, "poll_period_ns": settings.poll_period_ns, "batch_duration_ns": settings.batch_duration_ns,
        "precision": settings.precision, "consecutive_checks": settings.consecutive_checks, "window_groups": settings.window_groups, "min_duration_ns": settings.min_duration_ns,
        "max_duration_ns": settings.max_duration_ns, "rows_written": samples[-1][1],
    }
    if would:
        facts |= {"would_stop_ns": would.window_end_ns, "would_be_steady_state_throughput": would.steady_state_throughput, "would_be_relative_half_width": would.relative_half_width, "would_be_warmup_end_ns": would.warmup_end_ns}
    rows = [(run_id, i, t, n) for i, (t, n) in enumerate(samples)]
    return facts, spark.createDataFrame(rows, PROGRESS)


def _rows_so_far(node) -> int:
    """Rows that the topmost filter of a plan has put out in tasks that have ended."""
    while node.nodeName() != "Filter":
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        elif node.nodeName().endswith("QueryStage"):
            node = node.plan()
        elif node.children().size():
            node = node.children().apply(0)
        else:
            return 0
    return int(node.metrics().apply("numOutputRows").value())


class BackgroundRun:
    """A job in a thread and job group of its own, which can be waited for and cancelled."""

    _taken: set[str] = set()
    _lock = threading.Lock()

    def __init__(self, spark: SparkSession, work, run_id: str | None = None):
        self.spark, self.work, self.run_id = spark, work, run_id or uuid.uuid4().hex
        self._result: Future = Future()
        self._cancelled = False

    def start(self) -> BackgroundRun:
        with self._lock:
            if self.run_id in self._taken:
                raise InvalidAction(f"the run id {self.run_id} is taken")
            self._taken.add(self.run_id)

        def target() -> None:
            try:
                self.spark.sparkContext.setJobGroup(self.run_id, self.run_id, interruptOnCancel=True)
                self._result.set_result(self.work())
            except BaseException as error:  # noqa: BLE001
                self._result.set_exception(RunCancelled(f"{self.run_id} was cancelled") if self._cancelled else error)

        self._thread = InheritableThread(target=target, daemon=True)
        self._thread.start()
        return self

    def done(self) -> bool:
        return self._result.done()

    def cancel(self) -> None:
        self._cancelled = True
        while not self.done():
            self.spark.sparkContext.cancelJobGroup(self.run_id)
            self._thread.join(0.2)

    def wait(self, timeout: float | None = None):
        return self._result.result(timeout)
