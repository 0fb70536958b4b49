"""The record queries over whole texts, by brute force."""

import hashlib
import re

from refsift import queries

TEXTS = ["a title\nsee 10.1234/later.doi, and\nthe end of the the text", "x" * 90 + " 10.4321/far-off)", "", None, "der  rest\n\nles and LES with", "one line"]


def test_whole_texts(spark, tmp_path):
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {n: {r["doc_id"]: r for r in queries.queries()[n](spark, str(tmp_path)).collect()} for n in ("doi_extract", "tokens_overlap", "inverted_index_rebuild")}
    for i, t in rows:
        t = t or ""
        own = f"10.{1000 + i}/ab.{i}"
        found = re.findall(r"10\.\d{4,}/[^\s\])},;]+", f"see ({own}). {t} 10.5555/x,y {own}")
        dois = list(dict.fromkeys(d.rstrip(".").rstrip(",").rstrip(")") for d in found))
        dois = [d for d in dois if len(d) > 8]
        assert (got["doi_extract"][i]["first"], got["doi_extract"][i]["n"]) == (dois[0], len(dois))
        words = {w for w in re.split(r"\s+", re.sub(r"[\W_]", " ", t).lower()) if len(w) > 2}
        assert (got["tokens_overlap"][i]["n"], got["tokens_overlap"][i]["hits"]) == (len(words), len(words & {"the", "and", "with", "der", "les"}))
        assert got["inverted_index_rebuild"][i]["digest"] == hashlib.md5(t.encode()).hexdigest()
    assert got["doi_extract"][0]["n"] == got["doi_extract"][1]["n"] == 3  # 10.5555/x and the text's own
