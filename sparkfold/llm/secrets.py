"""Secret scans: candidate strings, and a random forest that drops the false positives.

The forest is trained from labelled findings: (candidate, words before, words after, label). A
seeded set of made-up findings of common shapes stands in where the caller has none.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import random
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import small_batches

#: A candidate is a run of at least SHORTEST of these bytes that no plain word has the shape of (a digit, a mark inside,
#: a change of case inside), or any such run with a known prefix, an assignment or a word of NEAR_SECRETS before it.
SHORTEST = 8
RUN = re.compile(rb"[A-Za-z0-9_\-+/=.~!@#$%%^&*?]{%d,}" % SHORTEST)
#: Marks around a run that aren't part of it, unless a quote follows them.
MARKS = b".-~!?@#$%^&*:"
SHAPE = re.compile(rb"[0-9+/=~@#$%^&*]|[a-z][A-Z]|[A-Z][A-Z][a-z]|[!?_.][A-Za-z]")
AROUND = 3
TREES, DEPTH, CUTS, TRAIN_ROWS, SEED = 40, 9, 24, 6000, 20240229
SECRET = 0.5
KNOWN = re.compile(r"(AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_|sk_live_|xox[abpr]-|glpat-|AIza|npm_|eyJ")

#: Words that stand near secrets, words that stand near harmless digests, and common English stems.
NEAR_SECRETS = frozenset("token secret password passwd pwd key apikey api_key access_key secret_key bearer authorization auth credential credentials private client_secret aws_access_key_id aws_secret_access_key".split())
NEAR_DIGESTS = frozenset("commit sha sha1 sha256 md5 checksum digest hash revision etag uuid guid id isbn doi version build image integrity serial order invoice tracking".split())
COMMON = "the and ing ion ent tion for with that this from have are was not you all can her has one our out day get him his how man new now old see two way who boy did its let put say she too use data file name user test code list item page time view type node text line main core util model query table index cache store event state value field class error login admin image config server client report system service manager handler controller session request response document project package module example default public static string number".split()

_NEAR = re.compile(rb"(?i)(?:^|[^a-z0-9_])(?:%s)[^a-z0-9_]" % b"|".join(sorted(w.encode() for w in NEAR_SECRETS)))

FEATURES = ("length", "digits", "upper", "lower", "other", "switches", "surprise", "dictionary", "slashes", "dots", "extension", "underscores", "hex", "distinct", "near_secret", "near_digest", "assigned", "quoted", "uuid_form", "known_prefix", "same_case_hex", "digits_only", "marks", "date_form", "web_form", "quote_after")


@dataclass(frozen=True)
class Finding:
    candidate: str
    before: str
    after: str
    label: int = 0


def words_before(before: str) -> list[str]:
    return re.findall(r"[a-z0-9_]+", before.lower())[-AROUND:]


def assigned(before: str) -> bool:
    return before.rstrip("\"' ").endswith(("=", ":"))


def is_candidate(own: bytes, before: bytes) -> bool:
    """Whether the forest is to judge a run; runs of the shape of a plain word need a sign of a secret."""
    if SHAPE.search(own):
        return True
    if before.rstrip(b"\"' ").endswith((b"=", b":")) or KNOWN.match(own.decode()):
        return True
    words = before.split()[-AROUND:]
    return bool(_NEAR.search(b" " + b" ".join(words) + b" "))


def made_up_findings(n: int = TRAIN_ROWS, seed: int = SEED) -> list[Finding]:
    """Labelled findings of common shapes: keys and tokens (1); digests, paths, names, numbers and ids in harmless places (0)."""
    r = random.Random(seed)
    hexes = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    mixed = lambda k: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k))
    upper = lambda k: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=k))
    word = lambda: r.choice(COMMON)
    prose = lambda: " ".join(r.choices(COMMON, k=AROUND))
    near = lambda: r.choice(sorted(NEAR_SECRETS)) + r.choice(["=", ": ", ' = "', "='", ":", ' "'])
    harmless = lambda: r.choice(sorted(NEAR_DIGESTS)) + r.choice([" ", ": ", "=", "-"])
    b64 = lambda k: base64.b64encode(r.randbytes(k)).decode()
    letters = lambda k: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=k))
    marked = lambda k: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789!@#$%^&*?", k=k - 1)) + r.choice("aZ3x")
    phrase = lambda: r.choice(["", word()]) + word().title() + r.choice(["", "!", "@", "#", "_"]) + str(r.randint(1, 99999)) + r.choice(["x", "!1", "", "$s"])
    secrets = (
        lambda: ("AKIA" + upper(16), prose() + r.choice([" ", "=", ": "])),
        lambda: (hexes(r.choice([16, 18, 20, 24, 32, 40, 64])), prose() + " " + near()),
        lambda: (mixed(r.randint(18, 48)), prose() + " " + near()),
        lambda: (b64(r.randint(18, 48)), prose() + " " + near()),
        lambda: (r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "AIza", "npm_"]) + mixed(r.randint(24, 36)), prose() + r.choice([" ", "=", ": "])),
        lambda: (letters(r.randint(12, 40)), prose() + " " + near()),
        lambda: (marked(r.randint(8, 20)), prose() + " " + near()),
        lambda: (phrase(), prose() + " " + r.choice(["password", "passwd", "pwd", "secret", "credentials"]) + r.choice(["=", ": ", ' = "', "='", ":", " is "])),
        lambda: ("eyJ" + mixed(r.randint(16, 24)) + "." + "eyJ" + mixed(r.randint(20, 50)) + "." + mixed(30), prose() + r.choice([" Bearer ", " token: ", " "])),
    )
    harmless_kinds = (
        lambda: (hexes(r.choice([32, 40, 64])), prose() + " " + harmless()),
        lambda: (str(uuid.UUID(int=r.getrandbits(128))), prose() + " " + r.choice([harmless(), ""])),
        lambda: ("/".join(word() for _ in range(r.randint(3, 6))) + r.choice([".py", ".html", ".json", ".txt", "", "/" + str(r.randint(1, 2024))]), prose() + " "),
        lambda: ("_".join(word() for _ in range(r.randint(3, 5))) + r.choice(["", str(r.randint(0, 99))]), prose() + r.choice([" ", " " + near()])),
        lambda: ("".join(word().title() for _ in range(r.randint(3, 5))) + r.choice(["", str(r.randint(0, 9))]), prose() + " "),
        lambda: ("".join(r.choices("0123456789", k=r.randint(14, 19))), prose() + r.choice([" ", " " + harmless()])),
        lambda: (".".join(word() for _ in range(3)) + str(r.randint(1, 99)) + r.choice([".com", ".org", ".example"]), prose() + r.choice([" ", " www.", "@"])),
        lambda: (f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}", prose() + " "),
        lambda: (word() + "-" + word() + "-" + ".".join(str(r.randint(0, 30)) for _ in range(3)) + "-" + word(), prose() + " "),
        lambda: ("".join(word() for _ in range(r.randint(3, 6))) + r.choice(["", str(r.randint(0, 9))]), prose() + " "),
        lambda: (f"{r.randint(1, 12)}{r.choice('/-.')}{r.randint(1, 28)}{r.choice('/-.')}{r.randint(1950, 2030)}", prose() + " "),
        lambda: (f"{r.randint(1950, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", prose() + r.choice([" ", " on ", " date: ", " version="])),
        lambda: (f"{r.randint(200, 999)}{r.choice('-.')}{r.randint(200, 999)}{r.choice('-.')}{r.randint(1000, 9999)}", prose() + r.choice([" ", " call ", " phone: ", " tel. +"])),
        lambda: (word() + r.choice([".", "_", ""]) + word() + r.choice(["", str(r.randint(1, 99))]) + "@" + word() + r.choice([".com", ".org", ".example", ".net"]), prose() + r.choice([" ", " at ", " mail: ", " contact "])),
        lambda: (r.choice(["www.", "//www.", "//", ""]) + word() + word() + r.choice([".com", ".org", ".net", ".html"]) + r.choice(["", "/" + word() + "/" + word(), "/?" + word() + "=" + word()]), prose() + r.choice([" ", " https:", " http:", " (see "])),
        lambda: ("".join(word() for _ in range(2)) + r.choice(["", "s", "ing"]), prose() + " " + r.choice([near(), "password ", "secret ", "key "])),
        lambda: (word() + "-" + str(r.randint(1, 2030)) + r.choice(["", "-" + word()]), prose() + " "),
        lambda: (str(r.randint(1, 9999)) + r.choice([".", ","]) + str(r.randint(100, 99999)) + r.choice(["", "%", "km", "kg"]), prose() + " "),
        lambda: ("".join(r.choices("0123456789", k=r.randint(8, 13))), prose() + r.choice([" ", " " + harmless()])),
        lambda: (word().title() + r.choice([".", "%%%", "&&&", "$$$", "*"]) + word().title(), prose() + r.choice([" ", "### "])),
        lambda: (letters(2).upper() + "".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(6, 12))), prose() + " "),
        lambda: ("".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(8, 14))), prose() + " password=" + hexes(18) + " "),
        lambda: (word().title() + word().title() + r.choice(["", "s"]), prose() + r.choice([" ", " class ", " " + near()])),
    )
    out = []
    for i in range(n):
        label = i % 2
        candidate, before = r.choice(secrets if label else harmless_kinds)()
        if len(candidate) >= SHORTEST:
            out.append(Finding(candidate, before, r.choice(['"', "'", "", "", ","]) + " " + prose(), label))
    return out


_DATE = re.compile(r"\d{1,4}[-./]\d{1,3}[-./]\d{1,4}(?:T[\d.:]+)?$")
_WEB = re.compile(r"^//|www\.|[\w.]@[\w.]+\.[a-z]{2,}|\.(?:com|org|net|html?|example|edu|gov|io)\b")


class Featurizer:
    """Numbers of a finding; character transitions come from the harmless findings of the training set."""

    def __init__(self, harmless: list[str]):
        counts = np.ones((40, 40))
        for text in [*harmless, *COMMON]:
            c = self._codes(text)
            np.add.at(counts, (c[:-1], c[1:]), 1)
        self.bits = -np.log2(counts / counts.sum(1, keepdims=True))
        self.stems = re.compile("|".join(sorted({w for w in COMMON if len(w) > 2}, key=lambda w: (-len(w), w))))

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        b = np.frombuffer(text.lower().encode("ascii", "replace"), np.uint8).astype(np.int64)
        return np.where((b >= 97) & (b <= 122), b - 97, np.where((b >= 48) & (b <= 57), b - 48 + 26, 36 + (b == 95) + 2 * (b == 47)))

    def __call__(self, f: Finding) -> list[float]:
        t = f.candidate
        n = len(t)
        kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in t]
        codes = self._codes(t)
        low = t.lower()
        covered = sum(len(m) for m in self.stems.findall(low))
        near = words_before(f.before)
        is_hex = not re.search(r"[^0-9a-fA-F]", t)
        return [
            float(n), kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n,
            sum(a != b for a, b in zip(kinds[1:], kinds, strict=False)) / n, float(self.bits[codes[:-1], codes[1:]].mean()), covered / n,
            float(t.count("/")), float(t.count(".")), float(bool(re.search(r"\.[a-z]{2,5}$", t))), float(t.count("_") + t.count("-")), float(is_hex), len(set(t)) / min(n, 64),
            float(any(w in NEAR_SECRETS for w in near)), float(any(w in NEAR_DIGESTS for w in near)), float(assigned(f.before)), float(f.before[-1:] in "\"'" and f.before != ""),
            float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", t))), float(bool(KNOWN.match(t))),
            float(is_hex and (low == t or t.upper() == t)), float(t.isdigit()),
            float(sum(c in "!@#$%^&*?" for c in t)), float(bool(_DATE.match(t))), float(bool(_WEB.search(low))), float(f.after[:1] in "\"'" and f.after != ""),
        ]


class Forest:
    """Trees on bootstrap samples, a random part of the features at each split, Gini impurity, thresholds at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        self.trees = [self._grow(binned, x, y, cuts, rng.integers(0, len(x), len(x)), depth, rng) for _ in range(trees)]

    @staticmethod
    def _grow(binned, x, y, cuts, rows, depth, rng) -> np.ndarray:
        """Rows (feature, threshold, left, right, share of label 1); a leaf has feature -1."""
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, left: int) -> int:
            at = len(nodes)
            share = float(y[rows].mean()) if len(rows) else 0.5
            nodes.append([-1, 0, -1, -1, share])
            if not left or len(rows) < 4 or share in (0.0, 1.0):
                return at
            best = (np.inf, -1, -1)
            for j in rng.permutation(binned.shape[1])[: max(1, int(binned.shape[1] ** 0.5 + 1))]:
                if not len(cuts[j]):
                    continue
                width = len(cuts[j]) + 1
                n = np.bincount(binned[rows, j], minlength=width).cumsum()[:-1]
                one = np.bincount(binned[rows, j], weights=y[rows], minlength=width).cumsum()[:-1]
                m, ones = len(rows) - n, y[rows].sum() - one
                with np.errstate(divide="ignore", invalid="ignore"):
                    gini = np.where((n == 0) | (m == 0), np.inf, one * (1 - one / n) + ones * (1 - ones / m))
                k = int(gini.argmin())
                if gini[k] < best[0] - 1e-12:
                    best = (gini[k], int(j), k)
            if best[1] < 0:
                return at
            _, j, k = best
            low = binned[rows, j] <= k
            nodes[at][:2] = [j, float(cuts[j][k])]
            nodes[at][2] = split(rows[low], left - 1)
            nodes[at][3] = split(rows[~low], left - 1)
            return at

        split(rows, depth)
        return np.array(nodes)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of label 1 over the trees."""
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            while len(go := np.flatnonzero(tree[at, 0] >= 0)):
                t = tree[at[go]]
                low = x[go, t[:, 0].astype(np.int64)] <= t[:, 1]
                at[go] = np.where(low, t[:, 2], t[:, 3]).astype(np.int64)
            total += tree[at, 4]
        return total / len(self.trees)


@dataclass
class Scanner:
    features: Featurizer
    forest: Forest

    @classmethod
    def train(cls, findings: list[Finding] | None = None) -> Scanner:
        """From labelled findings, TRAIN_ROWS of them at most (those of the smallest hashes)."""
        rows = made_up_findings() if findings is None else sorted(findings, key=lambda f: hashlib.md5(repr(f).encode()).digest())[:TRAIN_ROWS]
        features = Featurizer([f.candidate for f in rows if not f.label])
        return cls(features, Forest(np.array([features(f) for f in rows]), np.array([float(f.label) for f in rows])))

    def scan(self, text: bytes) -> list[tuple[int, Finding]]:
        """Candidates of a text, each once, with where they begin."""
        out, upto = [], -1
        for m in RUN.finditer(text):
            at, own = m.start(), m[0]
            if b"=" in own.rstrip(b"="):  # name=value
                name, _, value = own.partition(b"=")
                at, own = at + len(name) + 1, value
            quoted = text[at + len(own) : at + len(own) + 1] in (b'"', b"'")
            kept = own.strip(b".-~") if quoted else own.strip(MARKS)
            at, own = at + own.find(kept) if kept else at, kept
            if len(own) < SHORTEST or at <= upto:
                continue
            before = text[max(0, at - 60) : at]
            if not is_candidate(own, before):
                continue
            upto = at
            after = text[at + len(own) : at + len(own) + 40]
            out.append((at, Finding(own.decode(), before.decode("utf-8", "replace"), after.decode("utf-8", "replace"))))
        return out


@functools.lru_cache(maxsize=2)
def _trained(findings: tuple[Finding, ...] | None) -> Scanner:
    return Scanner.train(list(findings) if findings is not None else None)


def scan(docs: DataFrame, findings: list[Finding] | None = None) -> DataFrame:
    """doc_id, begin, length, candidate_crc32, probability, secret: a row for each candidate of each row of docs.

    begin: in UTF-8 bytes of the text; secret: probability of SECRET and more. All runs of SHORTEST bytes and more
    are looked into. Null and empty texts have no candidates. The
    labelled findings, TRAIN_ROWS at most, are sent to the workers, each of which trains the same forest once.
    """
    import zlib

    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(tuple(sorted(findings, key=lambda f: hashlib.md5(repr(f).encode()).digest())[:TRAIN_ROWS]) if findings is not None else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _trained(known.value)
        for batch in batches:
            ids = batch.column("doc_id")
            rows: list[tuple] = []
            for first, some in tv.slices(tv.strings(batch.column("text"))):
                data, at = tv.raw(some)
                raw = data.tobytes()
                for d in range(len(some)):
                    rows += [(ids[first + d].as_py(), b, f) for b, f in scanner.scan(raw[at[d] : at[d + 1]])]
            p = scanner.forest.predict(np.array([scanner.features(f) for _, _, f in rows])) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2].candidate) for r in rows], pa.int32()), pa.array([zlib.crc32(r[2].candidate.encode()) for r in rows], pa.int64()), pa.array(p), pa.array(p >= SECRET)],
                ["doc_id", "begin", "length", "candidate_crc32", "probability", "secret"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, begin long, length int, candidate_crc32 long, probability double, secret boolean")
