"""The whole pipeline over odd rows."""

import hashlib
import random

import tokenizers

import corpus_pipeline
from sievework.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string"


def test_run(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    text = {k: " ".join(word() for _ in range(80)) for k in range(40)}
    rows = [(k, t, "en", f"s{k % 3}", len(t), "x") for k, t in text.items()]
    rows += [(100 + k, text[k], None, None, None, "x") for k in range(5)]  # copies
    rows += [(200, text[6] + " more", "en", "s0", 1, "x"), (7, text[7], "en", "s1", 1, "x"), (7, text[8] + " " + word(), "en", "s1", 1, "x")]
    rows += [(300, None, "en", "s0", 1, "x"), (301, "", "en", "s0", 0, "x"), (302, "short", "en", "s0", 5, "x"), (None, " ".join(word() for _ in range(90)), "en", "s1", 9, "x")]
    rows.append((400, " ".join(word() for _ in range(80)) + " mail me@example.org", "en", "s2", 9, "x"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert None in ids and 400 in ids and not ids & {300, 301, 302, 200, *range(100, 105)} and ids <= {*text, 400, None}
    library = tokenizers.Tokenizer.from_file(queries.TOKENIZER)
    decoded = {r["doc_id"]: library.decode(r["ids"], skip_special_tokens=False) for r in got}
    assert all(r["n_tokens"] == len(r["ids"]) for r in got) and "me@example.org" not in decoded[400].replace(" ", "")
    plain = {k: library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for k, t in text.items()}
    assert all(decoded[k] == plain[k] for k in ids - {7, 8, 400, None})
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    told = lambda rows: sorted(hashlib.sha256(str((r["doc_id"], list(r["ids"]))).encode()).hexdigest() for r in rows)
    assert told(got) == told(again)


def test_run_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
