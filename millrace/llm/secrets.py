"""Secret scans: patterns find candidates, a random forest removes false positives.

Candidates are values after words such as "token" or "password", known key formats
and long mixed strings. Each gets features of its length, of its character
transitions (log likelihood under a first-order model of words), of how much of it
dictionary words cover, of the path it is found in, and of the words beside it. A
random forest, grown here from labelled findings, scores them.

The given tables have no labelled findings, so by default the forest is trained on
findings that `labelled_findings` makes by rule from a fixed seed; `train` takes any
others. The dictionary comes from the words of a tokenizer vocabulary, whose path is
a parameter. Forest, dictionary and model have a fixed size and are broadcast; a
document is worked on alone and nothing is shuffled.

Defined results: null and empty texts give no row; repeated rows give repeated
findings; all candidates are scored, and of those that overlap secrets go before
others, then key formats before assigned values before long strings, then the higher
score, the earlier and the longer one; texts are scanned whole, whatever their length;
a null doc_id is passed on; a null path counts as empty; extra columns are not looked
at; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import random
import re
import string
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
NEAR = 48  # characters looked at on either side

# Words that announce a secret, words beside false positives, key formats.
KEY_WORDS = "token secret password passwd passphrase pwd api_key apikey api-key access_key accesskey auth_key authorization bearer client_secret private_key credential credentials".split()
HARMLESS_WORDS = "example sample dummy test fake placeholder your changeme xxx todo redacted sha sha1 sha256 md5 hash checksum digest commit revision rev uuid guid etag version integrity build id".split()
HARMLESS_PATHS = "test tests example examples sample samples docs doc fixture fixtures mock demo vendor lock".split()
FORMATS = {
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{30,}",
    "slack_token": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "jwt": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "url_password": r"(?<=://)[^\s:/@]+:[^\s/@]{3,}(?=@)",
}
_ANCHORS = {"aws_key": ("AKIA", "ASIA"), "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "slack_token": ("xox",), "google_key": ("AIza",), "stripe_key": ("k_live_", "k_test_"), "jwt": ("eyJ",), "private_key": ("-----BEGIN ",), "url_password": ("://",)}
_FORMATS = {k: re.compile(v) for k, v in FORMATS.items()}
_ASSIGNED = re.compile(r"(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, sorted(KEY_WORDS, key=len, reverse=True))) + r")s?[\"']?\s{0,4}(?:=>|:=|=|:)\s{0,4}(?:bearer\s)?[\"']?([^\s\"'<>]{6,})")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_NEAR_WORD = re.compile(r"[a-z0-9_-]+")
_ALPHABET = string.ascii_lowercase + "0"
FEATURES = ("length", "entropy", "transitions", "covered", "digits", "upper", "hex", "repeats", "kinds", "assigned", "format", "key_word_near", "harmless_near", "harmless_path", "harmless_inside", "commas")


class Candidate(NamedTuple):
    start: int
    end: int
    kind: str


def candidates(text: str) -> list[Candidate]:
    """Spans that may be secrets, in order; they may overlap."""
    found: list[Candidate] = []
    lower = text.lower()
    if any(k in lower for k in ("token", "secret", "passw", "passphrase", "pwd", "key", "auth", "bearer", "credential")):
        found += [Candidate(m.start(1), m.end(1), "assigned") for m in _ASSIGNED.finditer(text)]
    for kind, pattern in _FORMATS.items():
        if any(a in text for a in _ANCHORS[kind]):
            found += [Candidate(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    if max(map(len, text.split()), default=0) >= 20:
        for m in _LONG.finditer(text):
            s = m[0]
            if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
                found.append(Candidate(m.start(), m.end(), "long"))
    return sorted(set(found), key=lambda c: (c.start, -c.end, c.kind))


def _rank(kind: str) -> int:
    return {"assigned": 1, "long": 2}.get(kind, 0)


def findings(text: str, path: str, lexicon: Lexicon, forest: Forest, threshold: float = THRESHOLD) -> list[tuple[Candidate, float]]:
    """The candidates of a text with their scores, in order, without overlaps."""
    scored = [(c, forest.score(features(text, c, path, lexicon))) for c in candidates(text)]
    scored.sort(key=lambda x: (x[1] < threshold, _rank(x[0].kind), -x[1], x[0].start, -x[0].end, x[0].kind))
    kept: list[tuple[int, int, float, Candidate]] = []  # apart from each other, in order
    for c, score in scored:
        k = bisect_left(kept, (c.start,))
        if (k == 0 or kept[k - 1][1] <= c.start) and (k == len(kept) or kept[k][0] >= c.end):
            kept.insert(k, (c.start, c.end, score, c))
    return [(c, score) for *_, score, c in kept]


class Lexicon:
    """Dictionary words, and the log probabilities of one character after another in them."""

    def __init__(self, words: list[str]):
        self.words = frozenset(w for w in words if len(w) >= 4 and w.isascii() and w.isalpha() and w.islower())
        self.longest = max(map(len, self.words), default=0)
        counts = np.ones((27, 27))
        for w in self.words:
            for a, b in zip(w, w[1:]):
                counts[_ALPHABET.index(a), _ALPHABET.index(b)] += 1
        log = np.log(counts / counts.sum(axis=1, keepdims=True))
        self.after = {a + b: float(log[i, j]) for i, a in enumerate(_ALPHABET) for j, b in enumerate(_ALPHABET)}

    @classmethod
    def from_vocabulary(cls, path: str) -> Lexicon:
        """The whole words of a tokenizer file with word ends."""
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        return cls(sorted(t[:-4] for t in vocab if t.endswith("</w>")))

    def transitions(self, s: str) -> float:
        t = re.sub("[^a-z]", "0", s.lower())
        return sum(self.after[a + b] for a, b in zip(t, t[1:])) / max(1, len(t) - 1)

    def covered(self, s: str) -> float:
        """Share of the characters that dictionary words cover, longest words first from the left."""
        t, at, n = s.lower(), 0, 0
        while at < len(t):
            k = next((k for k in range(min(self.longest, len(t) - at), 3, -1) if t[at : at + k] in self.words), 0)
            n += k
            at += k or 1
        return n / max(1, len(t))


def features(text: str, c: Candidate, path: str, lexicon: Lexicon) -> list[float]:
    s = text[c.start : c.end].rstrip(".,;!)")
    times = Counter(s)
    n = max(1, len(s))
    before, after = text[max(0, c.start - NEAR) : c.start].lower(), text[c.end : c.end + NEAR].lower()
    near = set(_NEAR_WORD.findall(before)) | set(_NEAR_WORD.findall(after))
    parts = set(re.findall("[a-z0-9]+", path.lower()))
    low = s.lower()
    return [
        math.log(n),
        -sum(v / n * math.log2(v / n) for v in times.values()),
        lexicon.transitions(s),
        lexicon.covered(s),
        sum(x.isdigit() for x in s) / n,
        sum(x.isupper() for x in s) / n,
        float(all(x in "0123456789abcdefABCDEF" for x in s)),
        max(times.values(), default=0) / n,
        float(any(x.islower() for x in s)) + any(x.isupper() for x in s) + any(x.isdigit() for x in s) + any(not x.isalnum() for x in s),
        float(c.kind == "assigned"),
        float(c.kind in FORMATS),
        float(any(k in before for k in KEY_WORDS)),
        float(not near.isdisjoint(HARMLESS_WORDS)),
        float(not parts.isdisjoint(HARMLESS_PATHS)),
        float(any(w in low for w in ("example", "sample", "dummy", "your", "change", "xxx", "placeholder", "1234", "****"))),
        float("," in s or "(" in s),
    ]


# -- forest ---------------------------------------------------------------
class Forest:
    """Random forest of binary trees, as arrays."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]]):
        self.trees = trees

    def score(self, x: list[float]) -> float:
        total = 0.0
        for tree in self.trees:
            k = 0
            while True:
                j, t, left, right, share = tree[k]
                if j < 0:
                    break
                k = left if x[j] <= t else right
            total += share
        return total / len(self.trees)


def grow_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 8, seed: int = 5) -> Forest:
    """Trees on bootstrap samples, each split the best of some features by Gini impurity."""
    rng = np.random.default_rng(seed)
    m = max(1, int(math.sqrt(x.shape[1])) + 1)

    def grow(rows: np.ndarray, level: int, tree: list) -> int:
        at = len(tree)
        share = float(y[rows].mean())
        tree.append((-1, 0.0, 0, 0, share))
        if level == depth or share in (0.0, 1.0) or len(rows) < 6:
            return at
        best = None
        for j in rng.choice(x.shape[1], m, replace=False):
            v = x[rows, j]
            order = np.argsort(v, kind="stable")
            v, pos = v[order], np.cumsum(y[rows][order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            nl = cut + 1.0
            nr, pl = len(rows) - nl, pos[cut]
            pr = pos[-1] - pl
            impurity = pl * (1 - pl / nl) + pr * (1 - pr / nr)
            k = int(np.argmin(impurity))
            if best is None or impurity[k] < best[0]:
                best = (impurity[k], int(j), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best is None:
            return at
        _, j, t = best
        go = x[rows, j] <= t
        left = grow(rows[go], level + 1, tree)
        right = grow(rows[~go], level + 1, tree)
        tree[at] = (j, t, left, right, share)
        return at

    out = []
    for _ in range(trees):
        tree: list = []
        grow(rng.integers(0, len(y), len(y)), 0, tree)
        out.append(tree)
    return Forest(out)


def labelled_findings(lexicon: Lexicon, n: int = 3_000, seed: int = 3) -> Iterator[tuple[str, str, bool]]:
    """(text, path, is a secret) for made-up findings of common shapes."""
    r = random.Random(seed)
    words = sorted(lexicon.words)
    letters, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    prose = lambda k: " ".join(r.choices(words, k=k))
    good_path = lambda: r.choice(["src/util.py", "src/app.py", "config/prod.yml", "main.go", "", "lib/client.js", "deploy.sh", "news"])
    bad_path = lambda: r.choice([*["src/app.py", "notes.txt", ""] * 2, "tests/fixtures/a.json", "docs/example.md", "package.lock"])
    equals = lambda: r.choice([" = ", "=", ": ", " := "])
    quote = lambda s: r.choice([f'"{s}"', f"'{s}'", s])
    for _ in range(n // 2):
        kind = r.randrange(7)
        if kind == 0:
            s = pick(hexa, r.choice([32, 40, 48, 64]))
            value = f"{r.choice(KEY_WORDS)}{equals()}{quote(s)}"
        elif kind == 1:
            value = f"{r.choice(KEY_WORDS)}{equals()}{quote(pick(letters, r.randint(16, 48)))}"
        elif kind == 2:
            value = f"{r.choice(['password', 'pwd', 'passwd'])}{equals()}{quote(pick(letters + '!#%&*', r.randint(8, 16)))}"
        elif kind == 3:
            value = r.choice(["", "key "]) + r.choice(["AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(letters, 36), "xoxb-" + pick(string.digits, 12) + "-" + pick(letters, 24), "AIza" + pick(letters, 35), "sk_live_" + pick(letters, 24)])
        elif kind == 4:
            value = "Authorization: Bearer eyJ" + pick(letters, 24) + "." + pick(letters, 60) + "." + pick(letters, 43)
        elif kind == 5:
            value = f"https://{r.choice(words)}:{pick(letters, r.randint(10, 20))}@{r.choice(words)}.com/"
        else:
            value = f"-----BEGIN {r.choice(['RSA ', 'EC ', ''])}PRIVATE KEY-----"
        value = value.upper() if kind in (0, 1) and r.random() < 0.08 else value
        yield f"{prose(6)}{r.choice([' ', '. ', chr(10)])}{value} {prose(5)}", good_path(), True
    for _ in range(n - n // 2):
        kind = r.randrange(9)
        if kind == 0:
            value = f"{r.choice(['commit', 'sha1', 'revision', 'checksum', 'md5', 'sha256', 'digest'])}{r.choice([' ', ': ', '='])}{pick(hexa, r.choice([32, 40, 64]))}"
        elif kind == 1:
            value = f"{r.choice(KEY_WORDS)}{equals()}{quote(r.choice(['your_token_here', 'changeme', 'xxxxxxxxxxxxxxxx', 'example_key_1234', '<redacted>', 'placeholder', 'YOUR-API-KEY', 'dummy_secret', '${TOKEN}', 'os.environ', 'None,', 'process.env.KEY']))}"
        elif kind == 2:
            value = f"{r.choice(KEY_WORDS)}{equals()}{quote('_'.join(r.choices(words, k=r.randint(1, 3))))}"
        elif kind == 3:
            value = f"{r.choice(['id', 'uuid', 'guid'])}{equals()}{uuid.UUID(int=r.getrandbits(128), version=4)}"
        elif kind == 4:
            value = "/".join(r.choices(words, k=4)) + str(r.randint(1, 99))
        elif kind == 5:
            value = f"AKIA{r.choice(['IOSFODNN7EXAMPLE', 'XXXXXXXXXXXXXXXX', '1234567890123456'])}"
        elif kind == 6:
            value = "-".join(r.choices(words, k=5)) + "-" + str(r.randint(2000, 2030))
        elif kind == 7:
            value = f"the {r.choice(KEY_WORDS)}: {r.choice(words)}{r.choice(words)} {prose(4)}"
        else:
            value = f"data:image/png;base64,{pick(letters + '+/', r.randint(60, 200))}"
        yield f"{prose(6)}{r.choice([' ', '. ', chr(10)])}{value} {prose(5)}", bad_path(), False


def train(lexicon: Lexicon, findings=None) -> Forest:
    """A forest from labelled findings: (text with one finding, path, is a secret)."""
    xs, ys = [], []
    for text, path, label in labelled_findings(lexicon) if findings is None else findings:
        for c in candidates(text):
            xs.append(features(text, c, path or "", lexicon))
            ys.append(float(label))
    return grow_forest(np.array(xs), np.array(ys))


def scan(df: DataFrame, lexicon: Lexicon, forest: Forest, *, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, kind, start, end, secret_hash, score, is_secret), one for each candidate.

    Positions are in characters; secret_hash is the XXH3-64 of the found string, so
    that the result holds no secret.
    """
    shared = df.sparkSession.sparkContext.broadcast((lexicon, forest))
    names = ["doc_id", "kind", "start", "end", "secret_hash", "score", "is_secret"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, trees = shared.value
        for b in batches:
            rows = []
            for d, t, p in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                s = t.as_py() or ""
                for c, score in findings(s, p or "", lex, trees, threshold):
                    rows.append((d, c.kind, c.start, c.end, xxhash.xxh3_64_hexdigest(s[c.start : c.end]), score, score >= threshold))
            columns = [*zip(*rows)] or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    where = df[f"`{path}`"].cast("string") if path else None
    inputs = df.select(df[f"`{doc_id}`"].cast("long"), df[f"`{text}`"].cast("string"), (where if path else F.lit("")).alias("_path"))
    return inputs.mapInArrow(run, "doc_id long, kind string, start long, end long, secret_hash string, score double, is_secret boolean")
