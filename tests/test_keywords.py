from gradewright import fixed_values as fv
from gradewright.operators import keywords

TEXTS = ["主桁にひびわれと腐食", "主桁の腐食", "床版にひびわれ", "高欄、壁高欄の変形", "", "良好", "主桁主桁"]


def rows(spark, texts):
    return spark.createDataFrame([(t, "x" if i % 2 else "y") for i, t in enumerate(texts)], "t string, corpus string")


def brute(texts, members, damages, k):
    def top(words):
        counts = {label: sum(w in t for t in texts) for w, label in words.items()}
        return sorted((label for label in counts if counts[label]), key=lambda label: (-counts[label], label))[:k]

    word = {label: w for w, label in (members | damages).items()}
    return {(m, d): sum(word[m] in t and word[d] in t for t in texts) for m in top(members) for d in top(damages)}


def test_frequency(spark):
    got = {r["label"]: (r["n"], r["pct"]) for r in keywords.frequency(rows(spark, TEXTS), "t", fv.MEMBER_WORDS).collect()}
    assert got == {
        "Main Girder": (3, 300 / 7), "Deck Slab": (1, 100 / 7), "Railing/Parapet": (1, 100 / 7), "Wall Railing": (1, 100 / 7),
    }


def test_cooccurrence(spark):
    for k in (2, 8):
        got = keywords.cooccurrence(rows(spark, TEXTS), "t", k=k).collect()
        assert {(r["member"], r["damage"]): r["n"] for r in got} == brute(TEXTS, fv.MEMBER_WORDS, fv.DAMAGE_TYPE_WORDS, k)
        assert any(r["n"] == 0 for r in got)


def test_cooccurrence_by_corpus(spark):
    got = keywords.cooccurrence(rows(spark, TEXTS), "t", by=["corpus"]).collect()
    for corpus, kept in (("y", TEXTS[::2]), ("x", TEXTS[1::2])):
        found = {(r["member"], r["damage"]): r["n"] for r in got if r["corpus"] == corpus}
        assert found == brute(kept, fv.MEMBER_WORDS, fv.DAMAGE_TYPE_WORDS, 8)


def test_matrix(spark):
    long = keywords.cooccurrence(rows(spark, TEXTS), "t")
    wide = {r["member"]: r for r in keywords.as_matrix(long, ["Corrosion", "Crack"]).collect()}
    assert wide["Main Girder"]["Corrosion"] == 2 and wide["Deck Slab"]["Corrosion"] == 0


def test_no_hits(spark):
    assert keywords.cooccurrence(rows(spark, ["a", "b"]), "t").count() == 0
    assert keywords.frequency(rows(spark, ["a"]), "t", fv.MEMBER_WORDS).count() == 0
