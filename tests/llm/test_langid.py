"""Language identification against a plain version of the posterior; priors that overturn a text; edges."""

import html as html_lib
import math
import random
import re

import pytest

from tallyloom.llm import langid

VOCAB = {"en": ["the", "house", "with", "thing", "that", "where"], "de": ["der", "über", "nicht", "sch", "ein", "auch"], "fr": ["les", "été", "pour", "eau", "avec", "où"]}


def cells(text):
    b = bytes(c if c >= 0x80 else c | 0x20 if chr(c).isalpha() else 0x20 for c in text.encode())
    out = []
    for i in range(len(b) - 2):
        x, y, z = b[i : i + 3]
        if not (x == y == 0x20 or y == z == 0x20):
            out.append(((x << 16 | y << 8 | z) * 2654435761 % 2**32) >> 18)
    return out


def plain(rows, train):
    """(language, probability, text language) of rows (id, text, declared, host, domain, suffix), as the module describes."""
    langs = sorted({k for t, k in train if k and cells(t or "")})
    names = [*langs, "unknown"]
    counts = {k: [1] * langid.CELLS for k in langs}
    for text, k in train:
        for c in cells(text or "") if k else ():
            counts[k][c] += 1
    total = {k: sum(v) for k, v in counts.items()}
    score = {}
    for i, text, *_ in rows:
        cs = cells(text or "")
        w = min(len(cs), langid.MOST_TRIGRAMS) / max(1, len(cs))
        score[i] = (len(cs), [w * sum(math.log(counts[k][c] / total[k]) for c in cs) for k in langs] + [-w * len(cs) * math.log(langid.CELLS)])
    post = {}
    for i, (n, ll) in score.items():
        odds = [math.exp(x - max(ll)) for x in ll]
        post[i] = [x / sum(odds) for x in odds] if n else [0.0] * len(names)
    text_lang = {i: names[max(range(len(names)), key=lambda j, ll=ll: (ll[j], -j))] if n else "unknown" for i, (n, ll) in score.items()}
    votes = {}
    for i, _, _, host, domain, suffix in rows:
        for key in ((3, host, domain, suffix), (2, domain, suffix), (1, suffix), (0,)):
            votes.setdefault(key, [0.0] * len(names))
            votes[key] = [a + b for a, b in zip(votes[key], post[i], strict=True)]
    agree = {}
    for i, _, declared, *_ in rows:
        if score[i][0]:
            said = declared if declared in langs else ""
            agree[said, text_lang[i]] = agree.get((said, text_lang[i]), 0) + 1
    out = {}
    for i, _, declared, host, domain, suffix in rows:
        prior = [(v + 1) / (sum(votes[(0,)]) + len(names)) for v in votes[(0,)]]
        for key in ((1, suffix), (2, domain, suffix), (3, host, domain, suffix)):
            others = [max(0.0, v - p) for v, p in zip(votes[key], post[i], strict=True)]
            prior = [(v + langid.STRENGTH * p) / (sum(others) + langid.STRENGTH) for v, p in zip(others, prior, strict=True)]
        fused = [x + math.log(p) for x, p in zip(score[i][1], prior, strict=True)]
        if declared in langs:
            fused = [x + math.log((agree.get((declared, b), 0) + 1) / (sum(agree.get((x2, b), 0) for x2 in langs) + len(langs))) for x, b in zip(fused, names, strict=True)]
        best = max(range(len(names)), key=lambda j: (fused[j], -j))
        share = 1 / sum(math.exp(x - fused[best]) for x in fused)
        out[i] = (names[best], share, text_lang[i]) if score[i][0] else ("unknown", 1.0, "unknown")
    return out


def made(seed=2):
    rng = random.Random(seed)
    words = lambda k, n: " ".join(rng.choice(VOCAB[k]) for _ in range(n))
    train = [(words(k, 60), k) for k in VOCAB for _ in range(20)] + [("zzz", None), (None, "en"), ("x", "")]
    rows = [(i, words(k, rng.randint(2, 30)), rng.choice([k, k, "", "xx", "en"]), f"h{i % 5}", f"d{i % 3}", ["com", "de"][i % 2]) for i, k in enumerate(list(VOCAB) * 12)]
    # A host of German pages with one short ambiguous text, and the same text on an English host.
    rows += [(100 + i, words("de", 40), "de", "german", "g", "de") for i in range(12)] + [(200 + i, words("en", 40), "en", "english", "e", "com") for i in range(12)]
    rows += [(300, "the ein", "", "german", "g", "de"), (301, "the ein", "", "english", "e", "com"), (302, None, "de", "german", "g", "de"), (303, "12 !!", None, "", "", ""), (304, "qxzq wqkx zzqk xqwz kkqx qzwx xkqz zqxw wzqx kxqz", "", "h1", "d1", "com")]
    return train, rows


def test_posterior_equals_a_plain_version(spark):
    train, rows = made()
    model = langid.train_text_model(spark.createDataFrame(train, "text string, lang string").repartition(3))
    want = plain([(i, t, d or "", h, m, s) for i, t, d, h, m, s in rows], train)
    got = {r.id: r for r in langid.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string").repartition(4), model).collect()}
    assert set(got) == set(want)
    for i, (language, share, text_language) in want.items():
        assert got[i].language == language and got[i].text_language == text_language and got[i].probability == pytest.approx(share, abs=1e-3), i
    # The prior of the host decides where the text doesn't.
    assert got[300].language == "de" and got[301].language == "en" and got[300].text_language == got[301].text_language


def test_ties_repeats_long_texts_and_clashing_columns(spark):
    train = spark.createDataFrame([("aaa bbb", "b"), ("aaa bbb", "a")], "text string, lang string")
    model = langid.train_text_model(train)
    rows = [(1, "aaa bbb " * 300_000, "", "", "", "", "x", 1), (1, "aaa bbb", "", "", "", "", "x", 1), (1, "aaa bbb", "", "", "", "", "x", 1), (None, "", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, domain string, suffix string, language string, ll int").repartition(2)
    got = sorted((r.id or 0, r.language) for r in langid.identify(df, model).collect())
    assert got == [(0, "unknown"), (1, "a"), (1, "a"), (1, "a")]  # equal probabilities go to the first
    pages = spark.createDataFrame([(1, "http://A.Example.org:80/x", "<html lang=a><p>aaa bbb", "t", 1), (2, None, None, "t", 1)], "page_id long, url string, html string, text string, host int")
    evidence = {r.id: r for r in langid.page_evidence(pages).collect()}
    assert (evidence[1].declared, evidence[1].host, evidence[1].domain, evidence[1].suffix) == ("a", "a.example.org", "example.org", "org") and evidence[2].text == ""
    assert html_lib.unescape("&amp;") == "&" and re.search("aaa", evidence[1].text)
