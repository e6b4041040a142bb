"""Run the engine's workloads one after the other: python -m larkspur.run [folder]. Stops at the first failure."""

from __future__ import annotations

import logging
import sys
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import attention, quality, sequences
from .sources import events as src
from .sources.records import Records, experiment, get_logger, log_event, timed, write_report
from .system import Config, FeatureSystem


def steps(spark: SparkSession, folder: str) -> list[tuple[str, Callable[[], object]]]:
    system = FeatureSystem(spark, Config(f"{folder}/system"))
    made = src.made_stream_events(spark, 1000)

    def check() -> DataFrame:
        report = quality.quality_totals(quality.validated(made, require_timestamp=True))
        write_report(report, f"{folder}/quality")
        return report

    def stream() -> int:
        system.produce(made)
        system.process_stream()
        return system.cells().count()

    def predict() -> int:
        return system.predict(made.select("user_id").distinct(), [0, 60, 120]).count()

    def sequence() -> dict:
        found = sequences.stratified_split(sequences.examples(src.sample_events(spark)))
        vocab, model = sequences.vocabulary(found), attention.AttentionModel()
        fitted = model.fit(found.where("not is_test"), vocab)
        attention.save(fitted, model, f"{folder}/model", spark)
        sequences.save_vocabulary(vocab, f"{folder}/vocabulary")
        return attention.evaluate(model.predict(found.where("is_test"), vocab, fitted)).first().asDict()

    return [
        ("quality", check), ("batch", lambda: system.run_batch_features(src.made_batch_events(spark, 1000)).count()), ("stream", stream),
        ("predictions", predict), ("placement", lambda: [tuple(r) for r in system.key_distribution().collect()]), ("sequences", sequence),
    ]


def main(folder: str) -> None:
    spark = SparkSession.builder.appName("larkspur").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    logger, log = get_logger("larkspur.run"), Records(spark, f"{folder}/experiments")
    logger.setLevel(logging.INFO)
    for name, step in steps(spark, folder):
        done = timed(name, step)
        log.append(experiment(spark, name, "seconds", done["seconds"], "seconds"))
        log_event(logger, "step done", step=name, seconds=round(done["seconds"], 3), result=str(done["result"]))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else tempfile.mkdtemp(prefix="larkspur-run-"))
