"""Screens that are kept: one pass over the mixtures, whose rows, counts and manifest all reports share."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import tidy
from ..operators import reports, select
from ..operators.features import Book
from ..sources import files
from ..sources.catalog import BANNED, BIASES, INGREDIENTS, PHASES, TARGETS, catalog
from .screening import narrow, screened, slim, widened

#: Most rows of a profile in any report but ledgers.
TOP = 20
#: How reports are written: ledgers take 0.91 of the bytes of level 3.
PARQUET = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}
#: Most ids of leaders that are broadcast to look up their rows.
LEADERS = 500_000
#: Changes whenever the same inputs give other rows.
VERSION = 4
#: The counts that are taken as rows are written.
COUNTS = {"n_rows": "count(1)", "rejected_or_review": "count_if(gate_status IN ('REJECTED', 'REVIEW'))", "n_passed": "count_if(gate_status = 'PASSED')", "n_rejected": "count_if(gate_status = 'REJECTED')", "n_review": "count_if(gate_status = 'REVIEW')", "n_positive": "count_if(score > 0)"}


class Run:
    """Screened rows as a table (stored), without what can be computed again of a row, and what is known of them: key, inputs, parameters and counts."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict) -> None:
        self.spark, self.path, self.manifest = spark, path, manifest
        self.stored = spark.read.parquet(f"{path}/{manifest['rows']}")
        self.rows = self.widened(self.stored)

    def widened(self, stored: DataFrame) -> DataFrame:
        """All columns of some of the stored rows."""
        own = self.manifest["book"]
        return widened(stored, own and Book.of(self.spark, **own))

    def counts(self) -> DataFrame:
        """One row of the counts taken as the rows were written: nothing is read."""
        own = self.manifest["counts"]
        return self.spark.range(1).select(*[F.lit(own[c]).cast("long").alias(c) for c in COUNTS])

    def gate_summary(self) -> DataFrame:
        return self.counts().select("n_rows", "rejected_or_review")

    def delete(self) -> None:
        files.delete(self.spark, self.path)


def key_of(inputs: dict, parameters: dict) -> str:
    fixed = hashlib.sha256("\n".join((INGREDIENTS, TARGETS, PHASES, BIASES, BANNED)).encode()).hexdigest()
    return hashlib.sha256(json.dumps([VERSION, fixed, inputs, parameters], sort_keys=True).encode()).hexdigest()[:32]


def _manifest(spark: SparkSession, path: str, put: dict | None = None) -> dict | None:
    """The manifest below path, or None; put: writes it. It comes last, so that rows with one are whole."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if put is None:
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(json.dumps(put, sort_keys=True).encode()))
    finally:
        stream.close()
    return put


def _root(spark: SparkSession) -> str:
    """The folder of this application's runs."""
    return f"{files.root(spark)}/mixscreen-runs-{spark.sparkContext.applicationId}"


def kept_run(spark: SparkSession, inputs: list[str], make: Callable[[], DataFrame], cat: DataFrame | None = None, **parameters: str | float | None) -> Run:
    """The run of the rows that make() gives, made if this application has none of these inputs and parameters yet.

    inputs: paths of all that make() reads; files that came, went or changed make another run. parameters: what else the
    rows depend on, such as a seed. cat: the catalog that make() screens by; features and phase shares are then not
    stored but computed again by it when they are read. Counts come from an Observation in the pass that writes. A run stays until its
    delete() or delete_runs(). A run that broke off has no manifest and is made anew; an empty input gives an empty run.
    """
    found = files.fingerprint(spark, inputs)
    book = None if cat is None else Book(cat)
    own = book and {"codes": book.codes, "vectors": book.vectors}
    key = key_of({"paths": sorted(inputs), **found}, parameters | ({"book": own} if own else {}))
    path = f"{_root(spark)}/{key}"
    manifest = _manifest(spark, path)
    if manifest is None:
        seen = Observation()
        rows = slim(make()).observe(seen, *[F.expr(sql).alias(c) for c, sql in COUNTS.items()])
        folder = f"rows-{uuid.uuid4().hex}"  # so that two that make the same run at once don't meet
        with files.swept(spark):
            narrow(rows, book is not None).write.option("compression", "zstd").parquet(f"{path}/{folder}")
        counts = dict.fromkeys(COUNTS, 0) | {c: int(n) for c, n in files.observed(spark.read.parquet(f"{path}/{folder}"), seen).items()}
        manifest = _manifest(spark, path, {"key": key, "rows": folder, "inputs": {"paths": sorted(inputs), **found}, "parameters": parameters, "book": own, "version": VERSION, "counts": counts})
    return Run(spark, path, manifest)


def screen_run(header: DataFrame, lines: DataFrame, inputs: list[str], **parameters: str | float | None) -> Run:
    cat = catalog(header.sparkSession)
    return kept_run(header.sparkSession, inputs, lambda: screened(header, lines, cat), cat, **parameters)


def delete_runs(spark: SparkSession) -> None:
    """Deletes all runs of this application: no DataFrame of theirs can be read afterwards."""
    files.delete(spark, _root(spark))


def report_set(run: Run, best: DataFrame | None = None) -> dict[str, DataFrame]:
    """All reports of a run, by name; best: its rows with the leaders among them, if these were picked."""
    rows, best = run.rows, run.rows if best is None else best
    return {
        "champions": reports.flat(reports.champions(best)), "shortlist": reports.flat(reports.shortlist(best)), "top": reports.flat(select.top(select.dedup_diverse(best), TOP)), "decisions": reports.ledger(rows), "rejected": reports.rejected(rows),
        "requests": reports.review_requests(best), "profiles": reports.archetype_summary(rows).select("archetype", "n_rows", "n_passed", F.col("best.candidate_id").alias("best_id"), tidy("best.score", 8).alias("best_score")), "gate": run.gate_summary(),
    }


def write_reports(run: Run, path: str) -> dict[str, DataFrame]:
    """Writes all reports of a run below path, a folder each, and the manifest; gives them as read back. Rows are screened once.

    The few rows that reports of the best have are picked first, by keys and scores alone, and all these reports are
    made of them; rejected rows are taken from the decisions, not made again.
    """
    out = {}
    with files.swept(run.spark):
        ids = files.small_side(files.written(select.leaders(run.rows, TOP)), LEADERS)
        best = files.written(run.widened(run.stored.join(ids, "candidate_id", "left_semi")))
        for name, df in report_set(run, best).items():
            df = reports.stopped(out["decisions"]) if name == "rejected" else df
            df.write.options(**PARQUET).parquet(f"{path}/{name}")
            out[name] = run.spark.read.parquet(f"{path}/{name}")
    _manifest(run.spark, path, run.manifest)
    return out
