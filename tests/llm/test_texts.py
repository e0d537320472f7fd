"""License scans, sentence pieces, surrogates, quality rules: rows against plain Python."""

import collections
import hashlib
import re

import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gradewright.llm import licenses, pieces, quality, surrogates
from tests.llm.cases import BASE, hard_documents, no_documents, plain
from tests.oracle import plan

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def naive_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i: i + 8])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    docs = hard_documents(spark).unionByName(spark.createDataFrame(
        [(20, "a b c d e f g h " * 2), (21, "a a a a a a a a a"), (22, "x\ny\nx\n \n \nx"), (23, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8")],
        "doc_id long, text string"), allowMissingColumns=True)
    made = quality.judge(docs)
    for r in made.select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect():
        n, *rest = naive_quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 20 or 100 * rest[3] > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    assert made.where("doc_id = 1").first()["kept"]
    assert not re.search("Exchange|EvalPython|InArrow|InPandas", plan(made))


def test_quality_keeps_rows_and_columns(spark):
    docs = hard_documents(spark)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert [r[0] for r in plain(kept, "doc_id")] == [1, 2, 2, 11]
    assert quality.keep(no_documents(spark)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \n#|", max_size=80), min_size=1, max_size=20))
def test_quality_measures_of_random_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in quality.measures(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == naive_quality(r["text"])


def naive_licenses(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    hits = [(t, i) for t in licenses.TEMPLATES for i in range(len(w)) if w[i: i + len(t.key)] == t.key]
    base = [i for t, i in hits if t.base]
    share = [sum(a == b for a, b in zip(w[i:], t.words)) / len(t.words) for t, i in hits]
    return (len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({t.label for t, _ in hits if t.base})),
            ",".join(sorted({t.label for t, _ in hits})), round(max(share, default=0.0), 6))


@pytest.mark.parametrize("seed", range(3))
def test_license_scan(spark, seed):
    import random

    rng = random.Random(seed)
    parts = [t.phrase for t in licenses.TEMPLATES] + [" ".join(t.words) for t in licenses.TEMPLATES] + ["license", "MIT", "version 2", "under the", "é word", "cc-by"]
    texts = [rng.choice([" ", "\n", "--"]).join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    docs = hard_documents(spark).unionByName(
        spark.createDataFrame([(100 + i, t if i % 2 else t.title()) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    made = licenses.scan(docs)
    for r in made.collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == naive_licenses(r["text"])
    assert made.count() == docs.count()
    assert not re.search("Exchange|EvalPython|InArrow|InPandas", plan(made))
    assert licenses.scan(no_documents(spark)).count() == 0


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = hard_documents(spark)
    for r in pieces.encode(docs, MODEL).collect():
        assert list(r["ids"]) == model.encode(r["text"] or "")
        assert r["decoded"] == model.decode(list(r["ids"]))
    assert pieces.encode(no_documents(spark), MODEL).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tab.éÉ你"), st.characters(codec="utf-8")), max_size=30), max_size=5))
def test_marked_words_give_the_whole_texts_ids(texts):
    import numpy as np

    made = SEGMENTER.encode(texts)
    assert [np.frombuffer(m, "<i4").tolist() for m in made] == [SEGMENTER.model.encode(t) for t in texts]


SEGMENTER = pieces.Segmenter(MODEL)


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_WORDS", 3)
    own = pieces.Segmenter(MODEL)
    for text in ("one two three four five", "six seven " + "long" * 40, "one two"):
        assert own.encode([text]) == SEGMENTER.encode([text])
    assert max(map(len, own.table)) <= pieces.LONG_WORD


PRIVATE = (
    "Mail the.72@mail3.example.com or THE.72@mail3.example.com, +1 (275) 555-5927, card 4111 1111 1111 1111 or 4111111111111112, "
    "host 152.143.123.131, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\". Mrs Weber met Anna Weber and Мария Петров; v1.2.3 of 2024-01-01."
)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_surrogates_keep_type_and_format(spark):
    docs = spark.createDataFrame([(1, PRIVATE), (2, "again 152.143.123.131"), (3, None), (4, ""), (5, BASE)], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in surrogates.replace(docs).collect()}
    found = {(e["kind"], e["entity"]): e["surrogate"] for r in rows.values() for e in r["entities"]}
    assert {k for k, _ in found} == {"email", "phone", "card", "ip", "secret", "name"}
    for (kind, entity), made in found.items():
        assert entity not in rows[1]["text"]
        if kind != "name":
            shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", s)))
            assert shape(made) == shape(entity) or kind == "secret" and len(made) == len(entity) and re.fullmatch("[0-9a-f]+", made)
        if kind == "card":
            assert luhn(re.sub(r"\D", "", made)) == luhn(re.sub(r"\D", "", entity))
    assert found["name", "Mrs Weber"].split()[1] == found["name", "Anna Weber"].split()[1]
    assert found["name", "Anna Weber"].split()[0] in surrogates.GIVEN["f", "latin"]
    assert found["name", "Мария Петров"].split()[0] in surrogates.GIVEN["f", "cyrillic"]
    assert rows[2]["text"] == "again " + found["ip", "152.143.123.131"]
    assert rows[3]["text"] is None and rows[4]["text"] == "" and rows[5]["text"] == BASE
    assert rows[1]["text"].endswith("v1.2.3 of 2024-01-01.")
    other = surrogates.replace(docs, surrogates.Key("another")).where("doc_id = 2").first()["text"]
    assert other != rows[2]["text"]


def mod_97(number):
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97


def test_one_entity_in_several_forms(spark):
    """Forms of one number get forms of one surrogate; country, check digits and what tells the type stay."""
    accounts = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "GB29NWBK60161331926819", "FR1420041010050500013M02606",
                "NL91ABNA0417164300"]
    phones = ["+442079460958", "+44 20 7946 0958", "+12755555927", "+1 (275) 555-5927", "+4930901820", "+353 1 234 5678"]
    secrets = ["sk_live_" + "4eC39HqLyjWDarjtT1zdp7dc", "AKIA" + "IOSFODNN7EXAMPLE", "ghp_" + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", "github_pat_" + "11ABCDEFG0abcdefghijkl_mnopqrstuv",
               "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"]
    others = ["2001:db8:85a3:8d3:1319:8a2e:370:7348", "fe80::1ff:fe23:4567:890a", "3782 822463 10005", "378282246310005"]
    every = accounts + phones + secrets + others
    docs = spark.createDataFrame([(i, f"see {e} here") for i, e in enumerate(every)] + [(99, " and ".join(every))], "doc_id int, text string")
    rows = {r["doc_id"]: r for r in surrogates.replace(docs).collect()}
    made = {}
    for i, e in enumerate(every):
        (found,) = rows[i]["entities"]
        assert found["entity"] == e and e not in rows[i]["text"], e
        made[e] = found["surrogate"]
        assert made[e] in rows[99]["text"] and len(made[e]) == len(e)
    plain = lambda t: re.sub("[^A-Za-z0-9+]", "", t)
    for a in every:
        for b in every:
            assert (plain(a) == plain(b)) == (plain(made[a]) == plain(made[b]))
    for a in accounts:
        assert made[a][:2] == a[:2] and mod_97(plain(made[a])) == mod_97(plain(a)) == 1
        assert [c == " " for c in made[a]] == [c == " " for c in a]
    for p, code in zip(phones, ("+44", "+44", "+1", "+1", "+49", "+353")):
        assert made[p].startswith(code) and re.sub(r"\d", "0", made[p]) == re.sub(r"\d", "0", p)
    for t, prefix in zip(secrets, ("sk_live_", "AKIA", "ghp_", "github_pat_", "eyJ")):
        assert made[t].startswith(prefix) and made[t][len(prefix):] != t[len(prefix):]
    for t in others[2:]:
        assert made[t][:2] == "37" and luhn(plain(made[t]))


def test_titles_tell_the_gender_of_unknown_names(spark):
    docs = spark.createDataFrame([(1, "Mr. Zaphod Weber, Frau Trillian Weber, Dr. Weber")], "doc_id int, text string")
    made = {e["entity"]: e["surrogate"].split() for e in surrogates.replace(docs).first()["entities"]}
    assert made["Mr. Zaphod Weber"][1] in surrogates.GIVEN["m", "latin"]
    assert made["Frau Trillian Weber"][1] in surrogates.GIVEN["f", "latin"]
    assert made["Dr. Weber"][0] == "Dr." and {m[-1] for m in made.values()} == {made["Dr. Weber"][1]}


def test_surrogates_are_distinct_and_no_entity(spark):
    """Octets of one digit leave few surrogates, names fewer still: collisions are certain."""
    ips = [f"{a}.{b}.{c}.1" for a in range(1, 9) for b in range(8) for c in range(8)]
    names = [f"{g} {s}" for g in surrogates.GIVEN["m", "latin"] for s in surrogates.SURNAMES["latin"][:8]]
    docs = spark.createDataFrame([(i, f"at {x} now") for i, x in enumerate(ips + names)], "doc_id int, text string")
    made = [e for r in surrogates.replace(docs).collect() for e in r["entities"]]
    assert len(made) == len(ips + names)
    assert len({e["surrogate"] for e in made}) == len(made)
    assert not {e["surrogate"] for e in made} & set(ips + names)


def test_surrogates_bear_hard_rows(spark):
    docs = hard_documents(spark)
    made = surrogates.without_private(docs)
    assert made.columns == docs.columns and plain(made, "doc_id", "text") == plain(docs, "doc_id", "text")
    assert surrogates.without_private(no_documents(spark)).count() == 0
    assert not re.search("EvalPython|InArrow|InPandas", plan(surrogates.replace(docs)))


def test_digests_of_ids(spark):
    """The query's strings are those of the plain ids."""
    import sentencepiece
    from gradewright.llm.queries import QUERIES

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op3_sentence_pieces"](spark, "/root/testdata/sf0.001").collect():
        ids = model.encode(texts[r["doc_id"]] or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))
