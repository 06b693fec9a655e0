import hashlib
import random
from array import array

import pytest
import sentencepiece

import __spark_entry__ as entry
from rolesift.llm import sentencepieces

PATH = sentencepieces.default_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(library, text):
    return array("I", library.encode(text, add_bos=True, add_eos=True)).tobytes()


def test_random_texts_as_in_the_library(library):
    rng, model = random.Random(5), sentencepieces.Model(PATH)
    letters = "   ▁\n\tabcdeéßthein the  0123.,'\"()[]<>|_-中文日本語🙂\x00́AZ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [" " * k + "the" + " " * (k % 40) for k in range(100)] + ["<s></s><unk><0x41>", "ab" * 3000, "\r\n" * 50]
    for text in texts:
        ids = ids_of(library, text)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(list(array("I", ids)))


def test_any_ids_decode_as_in_the_library(library):
    rng, model = random.Random(6), sentencepieces.Model(PATH)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(0, 3)]) for _ in range(rng.randint(0, 12))]
        assert model.decode(array("I", ids).tobytes()) == library.decode(ids)


def test_last_tokens_of_prefixes_are_those_of_their_encodings(library):
    model = sentencepieces.Model(PATH)
    for word in ("▁understanding", "▁internationally", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁"):
        for k in range(2, len(word) + 1):
            whole, shorter = model.tokens(word[:k]), model.merged(word[:k])
            assert whole == [model.ids[t] for t in shorter]


def test_documents(docs, rows, library):
    found = sentencepieces.decoded(sentencepieces.encoded(docs)).collect()
    assert set(docs.columns) | {"ids", "decoded"} == set(found[0].asDict()) and len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        assert r.text == texts[r.doc_id]
        assert bytes(r.ids) == ids_of(library, r.text or "") and r.decoded == (r.text or "").replace("▁", " ")


def test_repeated_null_and_clashing_rows(spark):
    odd = spark.createDataFrame([(None, "a", "old", b"x"), (None, "a", "old", b"y"), (1, None, None, None)], "doc_id long, text string, decoded string, ids binary")
    found = sentencepieces.decoded(sentencepieces.encoded(odd)).collect()
    assert sorted((r.doc_id is None, r.decoded, len(r.ids)) for r in found) == [(False, "", 8), (True, "a", 12), (True, "a", 12)]


def test_round_trip_gives_what_the_two_operators_give(docs):
    apart = sentencepieces.decoded(sentencepieces.encoded(docs)).drop("text")
    both = sentencepieces.round_trip(docs)
    assert sorted(apart.columns) == sorted(both.columns)
    found = sorted(apart.collect(), key=lambda r: r.doc_id)
    assert [r.asDict() for r in sorted(both.collect(), key=lambda r: r.doc_id)] == [r.asDict() for r in found]


def test_a_task_of_the_query_needs_one_worker(spark, docs, tmp_path, capsys):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    entry.queries()["op11_sentencepiece"](spark, str(tmp_path)).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT", 5)
    monkeypatch.setattr(sentencepieces, "PAIRS", 7)
    model, rng = sentencepieces.Model(PATH), random.Random(2)
    for _ in range(200):
        text = " ".join(rng.choice(["the", "ndoring", "thly.", "éreaux,", "x1"]) + rng.choice(["", "a", "er"]) for _ in range(20))
        assert model.encode(text) == ids_of(library, text)
    assert len(model.units) <= 5 and len(model.pairs) <= 7


def test_one_long_word_takes_linear_time(library):
    text = "thein" * 40_000
    assert sentencepieces.Model(PATH).encode(text) == ids_of(library, text)


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in entry.queries()["op11_sentencepiece"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = ids_of(library, d.text or "")
        decoded = library.decode(list(array("I", ids)))
        want = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == want


def test_empty_table(no_docs):
    assert sentencepieces.decoded(sentencepieces.encoded(no_docs)).count() == 0
