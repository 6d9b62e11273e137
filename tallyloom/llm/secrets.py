"""Operator 8: secret scans whose findings a random forest tells from false positives.

A candidate is a run of token characters of some length with more than letters of one case, parted where a name and its
value meet at an equals sign; a whole three-part web token; a value after a name such as ``password``; or a private-key block.
Of a very long run, the parts between separators are candidates too.  The forest looks at the candidate's length and character
classes, how often those change, how likely its letter pairs are in words and how much of it dictionary words
cover, at the path, and at the words around it.  It is trained on labelled findings: those that :func:`labelled_findings`
labels in the corpus by plain rules, and findings generated from a seed for forms that the corpus lacks.  A result has places
and hashes, never the secret itself.
"""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import tidy
from tallyloom.llm.textbytes import text_slices

#: Least length of a run that is a candidate, length beyond which a run's parts are candidates too, bytes of context on each side.
LEAST, MOST, CONTEXT = 16, 512, 64
#: Generated findings, most labelled findings, trees, depth, words of the dictionary.
GENERATED, MOST_LABELLED, TREES, DEPTH, DICTIONARY = 6000, 4000, 31, 9, 4096

# Names that go before secrets, words that go with examples, words that go with digests, parts of test paths.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "api", "apikey", "key", "auth", "bearer", "credential", "credentials", "access", "private", "signature")
EXAMPLE_WORDS = ("example", "sample", "dummy", "placeholder", "fake", "test", "your", "changeme", "todo", "xxxx", "redacted", "demo")
DIGEST_WORDS = ("sha", "sha1", "sha256", "sha512", "md5", "digest", "checksum", "hash", "commit", "revision", "uuid", "guid", "integrity", "etag", "id", "isbn", "build")
TEST_PATHS = ("test", "example", "sample", "fixture", "doc", "mock", "spec")

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in string.ascii_letters + string.digits + "_-+/="]] = True
# The value is looked at but not passed, so that a name in it has its own match.
_NAMED = re.compile(
    rb"""(?i)(?:password|passwd|passphrase|pwd|secret|token|bearer|auth|credentials?|signature|(?:api|access|private|secret|auth)[_-]?key|(?<![a-z])key)\d*\b["']?\s{0,3}(?::|=>?)"""
    rb"""(?=\s{0,3}"([^"\s]{6,})"|\s{0,3}'([^'\s]{6,})'|[ \t]{0,3}([^"'\s]{6,}))"""
)
_APART = (re.compile(rb"[^=/]+"), re.compile(rb"[^-=/+_]+"))
_INNER = re.compile(rb"[^=]+=*")
_JWT = re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_BLOCK = re.compile(rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
_WORD = re.compile(r"[a-z0-9]+")
_PARTS = re.compile(r"[A-Za-z]{3,}")


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays: the feature and bound of a split (left where at most the bound), or the share of secrets."""

    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray


@dataclass(frozen=True)
class Scanner:
    words: frozenset
    pairs: np.ndarray
    trees: tuple[Tree, ...]

    def features(self, candidates: list[tuple[str, str, str, str]]) -> np.ndarray:
        """A row per (candidate, before, after, path)."""
        return np.array([self._row(*c) for c in candidates], float).reshape(len(candidates), -1)

    def _row(self, text: str, before: str, after: str, path: str) -> list[float]:
        n = len(text)
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in text]
        letters = [ord(c) - 97 for c in text.lower() if "a" <= c <= "z"]
        likely = float(np.mean(self.pairs[letters[:-1], letters[1:]])) if len(letters) > 1 else -6.0
        covered = sum(len(w) for w in _PARTS.findall(text) if w.lower() in self.words)
        counts = np.array([text.count(c) for c in set(text)]) / n
        near, after_words = _WORD.findall(before.lower())[-4:], _WORD.findall(after.lower())[:3]
        around = near + after_words
        has = lambda words, of: float(any(w in words for w in of))
        tail = before.rstrip(" \"'`")[-1:]
        return [
            n, kinds.count("d") / n, kinds.count("u") / n, kinds.count("s") / n,
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), likely, covered / n,
            float(-(counts * np.log2(counts)).sum()), len(counts) / n,
            float(set(text.lower()) <= set("0123456789abcdef")), float(tail in ("=", ":")),
            has(SECRET_WORDS, near), has(EXAMPLE_WORDS, around), has(DIGEST_WORDS, near),
            float(any(x in path.lower() for x in TEST_PATHS)), float("/" in text[:-2] and "//" not in text and text.count("/") >= 2), text.count("-") / n,
        ]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                inner = t.feature[node] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(t.feature[node], 0)] <= t.bound[node]
                node = np.where(inner, np.where(go, t.left[node], t.right[node]), node)
            total += t.share[node]
        return total / max(1, len(self.trees))


def grow_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH, least: int = 4) -> Tree:
    """A tree by Gini impurity; each split looks at the square root of the features, at up to 24 bounds of each."""
    nodes: list[list] = []

    def build(rows: np.ndarray, level: int) -> int:
        me, share = len(nodes), float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, share])
        if level == depth or len(rows) < 2 * least or share in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        whole = share * (1 - share)
        for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]) + 1)), replace=False):
            v = x[rows, f]
            bounds = np.unique(np.quantile(v, np.linspace(0, 1, 26)[1:-1], method="lower"))
            low = v[:, None] <= bounds
            n = low.sum(axis=0)
            s = (low * y[rows][:, None]).sum(axis=0)
            m, q = len(rows) - n, y[rows].sum() - s
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = whole - (s * (1 - s / n) + q * (1 - q / m)) / len(rows)
            gain[(n < least) | (m < least)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), int(f), float(bounds[gain.argmax()]))
        if best[1] >= 0:
            go = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = build(rows[go], level + 1)
            nodes[me][3] = build(rows[~go], level + 1)
        return me

    build(np.arange(len(y)), 0)
    f, b, le, r, s = zip(*nodes, strict=True)
    return Tree(np.array(f), np.array(b), np.array(le), np.array(r), np.array(s))


def generated_findings(words: list[str], n: int = GENERATED, seed: int = 8) -> list[tuple[tuple[str, str, str, str], bool]]:
    """Labelled findings: random tokens in the places of secrets, and digests, identifiers, paths and words in theirs."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    draw = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    words = words or ["alpha", "beta", "gamma", "delta"]
    hexa, alnum, base64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    fill = lambda: " ".join(pick(words) for _ in range(4)) + " "
    out = []
    for k in range(n):
        after = " " + fill()
        path = pick(["src/app.py", "config/settings.yml", "deploy/env", "web/index.js", ""])
        if k % 2:
            text = pick([draw(hexa, pick([32, 40, 64])), draw(alnum, int(rng.integers(16, 64))), draw(base64, pick([24, 40, 44, 88])), pick(["AKIA", "ASIA"]) + draw(string.ascii_uppercase + string.digits, 16), pick(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + draw(alnum, 36)])
            name = pick(["token", "secret", "api_key", "apikey", "password", "auth", "access_key", "private key", "credential", "key"])
            before = fill() + pick([name, name.upper(), "my " + name]) + pick([" = \"", "=", ": ", " : '", " => '", ": Bearer ", "=\""])
            if rng.random() < 0.15 and not set(text) <= set(hexa):
                before = fill()  # a secret without its name
            out.append(((text, before, after, path), True))
            continue
        form = int(rng.integers(8))
        before = fill()
        if form == 0:
            text, before = draw(hexa, pick([32, 40, 64])), fill() + pick(["sha256:", "md5 ", "commit ", "checksum: ", "digest=", "revision ", "etag: "])
        elif form == 1:
            text, before = "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), fill() + pick(["uuid ", "id: ", "guid=", ""])
        elif form == 2:
            text = "/".join([pick(words) for _ in range(int(rng.integers(3, 6)))] + [str(int(rng.integers(1000)))])
        elif form == 3:
            text = pick(["_", "-"]).join([pick(words) for _ in range(int(rng.integers(3, 6)))] + [str(int(rng.integers(100)))])
        elif form == 4:
            text = "".join(pick(words).capitalize() for _ in range(int(rng.integers(3, 6))))
        elif form == 5:
            text, before = draw(alnum, int(rng.integers(16, 40))), fill() + pick(["example ", "sample ", "dummy ", "your "]) + pick(["token = ", "key: ", "secret="])
        elif form == 6:
            text, before, after = draw(string.digits, int(rng.integers(16, 24))), fill() + pick(["", "", "\"", "### ", "(", "no. ", "= ", "\n"]), pick(["", "\"", "$$$", ")", "."]) + after
        else:
            text = pick(["x", "0", "=", "-", "_"]) * int(rng.integers(16, 60)) + pick(["", "1", "A1"])
        out.append(((text, before, after, pick([path, "tests/fixtures/a.py", "docs/example.md"])), False))
    return out


def corpus_words(docs: DataFrame, text_col: str = "text", n: int = DICTIONARY) -> list[str]:
    """The words of 4 to 12 letters that most documents have, over all documents; ties in code-point order."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"\b[a-z]{4,12}\b"), F.lit(0)))
    words = docs.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r[0] for r in words.orderBy(F.desc("n"), "w").limit(n).collect()]


def label_of(candidate: str, before: str, after: str, covered: float) -> bool | None:
    """The label that plain rules give a finding; None where they say nothing.

    Secret: a name such as token or password and a separator stand right before it, nothing around it speaks of examples or
    digests, and it mixes at least ten different characters, letters and digits.  Not a secret: digits only without such a name;
    right after a word such as commit or sha256; next to a word such as example; made of words for the most part; fewer than
    six different characters.
    """
    near, late = _WORD.findall(before.lower())[-3:], _WORD.findall(after.lower())[:2]
    named = bool(near) and near[-1] in SECRET_WORDS and before.rstrip(" \t\"'`")[-1:] in ("=", ":", ">")
    example = any(w in EXAMPLE_WORDS for w in near + late)
    digest = bool(near) and near[-1] in DIGEST_WORDS
    mixed = any(c.isdigit() for c in candidate) and any(c.isalpha() for c in candidate)
    if named and mixed and len(set(candidate)) >= 10 and not example and not any(w in DIGEST_WORDS for w in near) and covered < 0.5:
        return True
    if (candidate.isdigit() and not named) or digest or example or covered >= 0.6 or len(set(candidate)) < 6:
        return False
    return None


def _views(batches, context: int = CONTEXT):
    """Of each slice of documents: its candidates, (id, document, rule, start and end in bytes) and the texts (candidate, before, after)."""
    for batch in batches:
        at = 0
        for data, offsets in text_slices(batch.column(1)):
            n = len(offsets) - 1
            data, offsets = np.insert(data, offsets[1:], 0x0A), offsets + np.arange(n + 1)  # no pattern joins two documents
            raw = data.tobytes()
            found = list(_candidates(data, offsets))
            if found:
                doc = np.searchsorted(offsets, [a for _, a, _ in found], "right") - 1
                views = []
                for (_, a, b), d in zip(found, doc.tolist(), strict=True):
                    low, high = max(int(offsets[d]), a - context), min(int(offsets[d + 1]), b + context)
                    views.append((raw[a:b].decode("utf-8", "replace"), raw[low:a].decode("utf-8", "ignore"), raw[b:high].decode("utf-8", "ignore")))
                yield batch.slice(at, n), data, offsets, doc, found, views
            at += n


def labelled_findings(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text", path: Column | None = None) -> DataFrame:
    """(id, candidate, before, after, path, label) for the candidates in whole texts that :func:`label_of` labels.

    The table holds secrets in the clear: it is for training and is not written.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    known = frozenset(words)

    def label(batches):
        for batch, _, _, doc, _, views in _views(batches):
            covered = [sum(len(w) for w in _PARTS.findall(c) if w.lower() in known) / len(c) for c, _, _ in views]
            labels = [label_of(c, x, y, share) for (c, x, y), share in zip(views, covered, strict=True)]
            some = [i for i, v in enumerate(labels) if v is not None]
            at = pa.array(doc[some])
            columns = [pa.array([views[i][k] for i in some], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *columns, batch.column(2).take(at), pa.array([labels[i] for i in some], pa.bool_())], names=["id", "candidate", "before", "after", "path", "label"])

    rows = _rows(docs, id_col, text_col, path)
    return rows.mapInArrow(tidy(label), f"`{id_col}` {kind}, candidate string, before string, after string, path string, label boolean")


def _rows(docs: DataFrame, id_col: str, text_col: str, path: Column | None) -> DataFrame:
    where = F.coalesce(path.cast("string") if path is not None else F.lit(""), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), where.alias("path"))


def train_scanner(words: list[str], labelled: DataFrame | None = None, trees: int = TREES, seed: int = 8, most: int = MOST_LABELLED, generated: int = GENERATED) -> Scanner:
    """A forest over labelled findings (candidate, before, after, path, label) and ``generated`` made ones.

    Of each label at most ``most`` / 2 labelled findings are taken, those first in a hash order of their contents.
    """
    findings = generated_findings(words, generated, seed)
    if labelled is not None:
        cols = ("candidate", "before", "after", "path")
        clean = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in cols]
        rows = labelled.filter("candidate <> '' and label is not null").select(*clean, F.col("label").cast("boolean").alias("label"))
        for label in (True, False):
            some = rows.filter(F.col("label") == label).orderBy(F.xxhash64(*cols, F.lit(seed)), *cols).limit(most // 2)
            findings += [((r[0], r[1], r[2], r[3]), r[4]) for r in some.collect()]
    pairs = np.ones((26, 26))
    for w in words:
        for a, b in zip(w, w[1:], strict=False):
            if "a" <= a <= "z" and "a" <= b <= "z":
                pairs[ord(a) - 97, ord(b) - 97] += 1
    blank = Scanner(frozenset(words), np.log(pairs / pairs.sum(axis=1, keepdims=True)), ())
    x, y, rng = blank.features([f for f, _ in findings]), np.array([label for _, label in findings], float), np.random.default_rng(seed)
    grown = []
    for _ in range(trees if len(y) else 0):
        rows = rng.integers(0, len(y), len(y))
        grown.append(grow_tree(x[rows], y[rows], rng))
    return Scanner(blank.words, blank.pairs, tuple(grown))


def _candidates(data: np.ndarray, offsets: np.ndarray):
    """(rule, start, end) in bytes of the candidates, each within one document."""
    raw = data.tobytes()
    run = _RUN[data]
    inner = offsets[1:-1]
    first, last = run.copy(), run.copy()
    first[1:] &= ~run[:-1]
    last[:-1] &= ~run[1:]
    begins = inner[(inner > 0) & (inner < len(data))]
    first[begins] = run[begins]
    last[begins - 1] = run[begins - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    fit = ends - starts >= LEAST
    seen: set[tuple[int, int]] = set()
    docs = np.asarray(offsets)
    whole_tokens = [m.span() for m in _JWT.finditer(raw)]
    for a, b in whole_tokens:
        seen.add((a, b))
        yield "web_token", a, b
    within = np.array([a for a, _ in whole_tokens] or [-1])
    for low, high in zip(starts[fit].tolist(), ends[fit].tolist(), strict=True):
        k = int(np.searchsorted(within, low, "right")) - 1
        if whole_tokens and k >= 0 and high <= whole_tokens[k][1]:
            continue  # a part of a web token
        spans = [m.span() for m in _INNER.finditer(raw, low, high)]
        if high - low > MOST:
            spans += [(low, high), *(m.span() for apart in _APART for m in apart.finditer(raw, low, high))]
        for a, b in spans:
            whole = a, b
            while a < b and raw[a] in b"=-/+_":
                a += 1
            while a < b and raw[b - 1] in b"-/+_":
                b -= 1
            part = raw[a:b]
            if len(part) >= LEAST and (a, b) not in seen and not (part[1:].islower() and part.isalpha() or part.isalpha() and part.isupper()):
                seen |= {whole, (a, b)}
                yield "token", a, b
    for m in _NAMED.finditer(raw):
        a, b = m.span(m.lastindex)
        b = a + len(raw[a:b].rstrip(b",;")) if m.lastindex == 3 else b
        if b - a >= 6 and np.searchsorted(docs, m.start(), "right") == np.searchsorted(docs, b - 1, "right") and (a, b) not in seen:
            seen.add((a, b))
            yield "named", a, b
    for m in _BLOCK.finditer(raw):
        if np.searchsorted(docs, m.start(), "right") == np.searchsorted(docs, m.end() - 1, "right"):
            yield "private_key", *m.span()


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", path: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """id, rule, start, length (code points), sha256, probability, is_secret for each candidate in whole texts.

    A private-key block is always a secret.  Null and empty texts have no candidates; a null path is empty.
    Rows that repeat an id give their candidates each.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches):
        for batch, data, offsets, doc, found, views in _views(batches):
            paths = batch.column(2).take(pa.array(doc))
            chance = scanner.probability(scanner.features([(*v, p) for v, p in zip(views, paths.to_pylist(), strict=True)]))
            rules = [r for r, _, _ in found]
            chance[[r == "private_key" for r in rules]] = 1.0
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            begin, end = (np.array([x[k] for x in found]) for k in (1, 2))
            columns = [batch.column(0).take(pa.array(doc)), pa.array(rules), pa.array(points[begin] - points[offsets[doc]]), pa.array(points[end] - points[begin])]
            columns += [pa.array([hashlib.sha256(data[a:b].tobytes()).hexdigest() for _, a, b in found]), pa.array(chance), pa.array(chance >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "rule", "start", "length", "sha256", "probability", "is_secret"])

    return _rows(docs, id_col, text_col, path).mapInArrow(tidy(find), f"`{id_col}` {kind}, rule string, start long, length long, sha256 string, probability double, is_secret boolean")
