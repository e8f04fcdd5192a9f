"""Language profiles against a plain count."""

import collections
import re

import numpy as np

from sparkloom.operators import languages as L

TEXTS = {
    "en": "The quick brown fox and the lazy dog went to the river, where the water was cold. ",
    "de": "Der schnelle Fuchs und der faule Hund gingen zum Fluß, wo das Wasser kalt war; schön. ",
    "uk": "Швидка лисиця і ледачий пес пішли до річки, де вода була холодна. ",
}


def plain(text):
    t = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip() + " "
    return collections.Counter(t[i : i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1) if t[i : i + k] != " ") if t != "  " else collections.Counter()


def order(counts):
    return sorted(counts, key=lambda g: (-counts[g], g))[: L.RANKS]


def test_profiles_and_distances(spark):
    rows = [(i, lang, text * (i + 1)) for i, (lang, text) in enumerate(TEXTS.items())] + [(9, None, "x y z"), (10, "en", "12 34"), (11, "en", None)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = {lang: plain(text * (i + 1)) for i, (lang, text) in enumerate(TEXTS.items())}
    got = collections.defaultdict(list)
    for r in L.language_profiles(d).orderBy("lang", "rank").collect():
        got[r["lang"]].append((r["gram"], r["n"]))
    assert got == {lang: [(g, c[g]) for g in order(c)] for lang, c in want.items()}
    asked = [(1, "Where is the other brown dog, and what was the water like to the fox? " * 3), (2, "Wo ist der andere Hund und wie war das Wasser für den schnellen Fuchs " * 3), (3, "Де вода і де лисиця, яка пішла до холодної річки з ледачим псом? " * 3), (4, "the fox"), (5, None), (6, "1 2 3 " * 50)]
    found = {r["doc_id"]: (r["found"], r["distance"]) for r in L.language_by_profile(spark.createDataFrame(asked, "doc_id long, text string"), L.language_profiles(d), "doc_id").collect()}
    assert found[4] == found[5] == found[6] == (None, None)
    for i, lang in ((1, "en"), (2, "de"), (3, "uk")):
        mine = order(plain(dict(asked)[i]))
        far = {k: sum(abs(order(c).index(g) - r) if g in order(c) else L.RANKS for r, g in enumerate(mine)) for k, c in want.items()}
        assert found[i] == (lang, far[lang]) and far[lang] == min(far.values())


def test_codes_sort_as_grams_do():
    codes, counts = L.grams(" ab 😀a ")
    texts = [L.gram_text(int(c)) for c in codes]
    assert texts == sorted(texts) and dict(zip(texts, counts.tolist(), strict=True)) == plain("ab") | {" 😀": 1, "😀": 1, "😀a": 1, " 😀a": 1, "b 😀": 1, "😀a ": 1, "a ": 1, "a": 2}
    assert L.out_of_place(np.array([5, 7]), np.array([7, 9, 5]), 10) == 3
