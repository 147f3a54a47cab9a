"""Divergence of sources against a dense count in Python."""

import random
import re
from collections import Counter

from docpipe.llm.divergence import source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "clash", "clash", i) for i, (t, lang, s) in enumerate(rows)], SCHEMA)


def terms_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)


def brute(rows, least, top):
    docs = [(terms_of(t), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {x[1] for x in docs}:
        mine = [x for x in docs if x[1] == lang]
        seen = Counter(t for words, _, _ in mine for t in set(words))
        kept = [t for t, n in seen.items() if n >= least]
        sources = {s for _, _, s in mine}
        counts = {s: Counter(t for words, _, s2 in mine if s2 == s for t in words if t in set(kept)) for s in sources}
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s in sources:
            pairs = [(sum(abs(share(counts[s], t) - share(counts[o], t)) for t in kept), o) for o in sources if o != s]
            best = [(share(counts[s], t) - share(whole, t), t) for t in kept if counts[s][t] and share(counts[s], t) > share(whole, t)]
            for part, items, stop in (("pair", pairs, None), ("term", best, top)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:stop]
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(ordered, 1)]
    return sorted(out)


def check(spark, rows, least, top=50):
    got = source_divergence(frame(spark, rows), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top)


def test_random_documents(spark):
    rng = random.Random(5)
    words = ["Alpha", "alpha", "béta", "ÉTÉ", "été", "it's", "x1y2", "日本", "🙂", "one_two", "Zz"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None]))
            for _ in range(150)]
    check(spark, rows, 10, 5)


def test_sources_without_a_common_term(spark):
    check(spark, [("a b c", "en", "x")] * 4 + [("d e", "en", "y")] * 4 + [("1 2", "en", "z")], 3)


def test_no_term_is_kept(spark):
    check(spark, [("a b", "en", "x"), ("c", "en", "y"), (None, "fr", None), ("", None, "y")], 30)


def test_nulls_empty_and_long_texts_and_repeats(spark):
    check(spark, [(None, None, None), ("", "", ""), ("word " * 30_000, "en", "x"), ("x" * 200_000, "en", "y"), ("word", "en", "y"),
                  ("word", "en", "y"), (" \t\n", "en", "z")], 2)


def test_empty_table(spark):
    assert source_divergence(frame(spark, [])).collect() == []
