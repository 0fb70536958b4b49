"""Facts over time: the same registry however the facts are batched, and after batches that were cut off."""

import json
import os
import shutil

import pytest

from refsift.operators import facts
from refsift.streaming import pending

LONG = "the share of hospitals that use predictive models rose in every year of the study"


def rows_of(part):
    """Facts of one file; some say what others say."""
    base = {"ref_number": 1, "fact_type": "qualitative", "statement": "s"}
    number = {"ref_number": 2, "fact_type": "quantitative", "unit": "%"}
    return {
        0: [base | {"exact_quote": LONG}, number | {"value": 12.5}, base | {"exact_quote": "short one"}],
        1: [base | {"exact_quote": LONG.replace("rose", "rises")}, number | {"value": 12.5004}, number | {"value": 13.0}, base | {"exact_quote": "short two"}],
        2: [base | {"exact_quote": "short one"}, base | {"ref_number": 3, "exact_quote": LONG}, number | {"value": 13.0}, number | {"value": 12.5, "unit": "mil"}],
        3: [base | {"exact_quote": LONG.upper()}, base | {"exact_quote": "short three"}],
    }[part]


def drop(folder, part):
    path = folder / f"{part}.json"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows_of(part)))
    os.utime(path, (1_600_000_000 + part, 1_600_000_000 + part))


@pytest.fixture
def imported(spark):
    contents = spark.createDataFrame([], "number int, content string, ref_type string, numbers array<double>")
    return lambda batch: facts.import_pending(batch, contents)


def told(spark, registry):
    found = pending.registered(spark, str(registry)).select("ref_number", "exact_quote", "value", "unit").collect()
    return sorted(map(str, found))


def run(spark, tmp_path, imported, name, most=100):
    pending.register(spark, str(tmp_path / "drop"), str(tmp_path / f"check-{name}"), str(tmp_path / name), imported, most).awaitTermination()


def test_the_same_however_batched(spark, tmp_path, imported):
    folder = tmp_path / "drop"
    folder.mkdir()
    for part in range(4):
        drop(folder, part)
    run(spark, tmp_path, imported, "one")
    run(spark, tmp_path, imported, "each", 1)
    want = told(spark, tmp_path / "one")
    assert told(spark, tmp_path / "each") == want and len(want) == 8
    assert len(list((tmp_path / "each").glob("batch=*"))) == 4 and len(list((tmp_path / "one").glob("batch=*"))) == 1


def test_after_a_restart(spark, tmp_path, imported):
    folder = tmp_path / "drop"
    folder.mkdir()
    for part in (0, 1):
        drop(folder, part)
    run(spark, tmp_path, imported, "reg", 1)
    first = told(spark, tmp_path / "reg")
    # a batch that is run again replaces itself: the folder's state of before, with the last batch half written
    held = spark.read.parquet(str(tmp_path / "reg" / "batch=1"))
    assert held.count() == 2
    (tmp_path / "reg" / "batch=1" / "_SUCCESS").unlink()
    assert len(told(spark, tmp_path / "reg")) == len(first) - 2
    shutil.rmtree(tmp_path / "check-reg" / "commits")
    (tmp_path / "check-reg" / "commits").mkdir()
    run(spark, tmp_path, imported, "reg", 1)
    assert told(spark, tmp_path / "reg") == first
    for part in (2, 3):
        drop(folder, part)
    run(spark, tmp_path, imported, "reg", 1)
    run(spark, tmp_path, imported, "one")
    assert told(spark, tmp_path / "reg") == told(spark, tmp_path / "one")
