"""Secret scans: base patterns, and character Markov models for what they miss.

Two kinds of first-order Markov models are trained from labelled samples: of random strings, one for each
alphabet that keys are drawn from, and of ordinary identifiers: the public names of modules that are installed here
(``MODULES``, at most ``samples`` of them), and compounds of their parts. A run of key characters is a secret if the
best random model is more likely than the ordinary one by ``threshold`` nats. Its segments between separators are
judged by themselves too, so that of a path with a key in it just the key is found. Runs of letters alone need capitals
and small letters and ``LETTERS`` nats. Spans of the base patterns always stay; the models add spans beside them.

Scans go row by row over whole texts, without a shuffle.

Defined results: null and empty texts have no spans; very long texts are scanned whole; spans that start together
are in the order of KINDS; rows that repeat give rows that repeat; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import importlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

THRESHOLD, LETTERS, SHORTEST, SAMPLES = 14.0, 24.0, 20, 4000

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: the same as runs of any length of which short ones are dropped
KINDS = ("assign", "access", "hex", "markov")
_HINTS = ("passw", "secret", "token", "api")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Modules whose public names are labelled as ordinary.
MODULES = (
    "argparse", "ast", "asyncio", "calendar", "collections", "concurrent.futures", "configparser", "csv", "datetime", "decimal", "email.message", "fractions", "functools", "gzip", "http.client", "inspect", "io", "ipaddress", "itertools",
    "json", "locale", "logging.handlers", "mailbox", "multiprocessing", "os", "pathlib", "pickle", "platform", "queue", "random", "selectors", "shutil", "socket", "sqlite3", "ssl", "statistics", "string", "subprocess", "tarfile", "tempfile",
    "threading", "tokenize", "traceback", "types", "typing", "unittest", "urllib.request", "uuid", "xml.dom.minidom", "zipfile", "numpy", "pyarrow", "pyspark.sql", "pyspark.sql.functions", "pyspark.sql.types",
)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
ALPHABETS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "0123456789abcdef",
    "0123456789ABCDEF",
)
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, 0, np.int64)
for _i, _c in enumerate(_CHARS):
    _CODE[ord(_c)] = _i + 1


def public_names(modules: tuple[str, ...] = MODULES) -> list[str]:
    """Public names of modules and of the classes in them."""
    found: set[str] = set()
    for name in modules:
        try:
            module = importlib.import_module(name)
        except ImportError:  # not installed, or not for this platform
            continue
        found.update(name.split("."))
        for x in dir(module):
            found.add(x)
            if isinstance(own := getattr(module, x, None), type):
                found.update(dir(own))
    return sorted(x for x in found if x.isascii() and not x.startswith("_") and len(x) > 1)


def ordinary_samples(n: int, seed: int, names: list[str]) -> list[str]:
    """At most ``n`` of the names, and as many identifiers, paths, versions and dates put together from their parts."""
    rng = random.Random(seed)
    parts = sorted({y.lower() for x in names for y in _PART.findall(x) if len(y) > 1})
    out = sorted(names, key=lambda x: hashlib.md5(f"{seed}{x}".encode()).digest())[:n]
    for _ in range(n):
        words = [rng.choice(parts) for _ in range(rng.randint(2, 6))]
        if rng.random() < 0.5:
            words.insert(rng.randrange(len(words) + 1), str(rng.choice((rng.randint(0, 99), rng.randint(1990, 2030), rng.randint(0, 9)))))
        style = rng.randrange(6)
        if style == 0:
            words = [x.capitalize() for x in words]
        elif style == 1:
            words = [words[0], *(x.capitalize() for x in words[1:])]
        elif style == 2:
            words = [x.upper() for x in words]
        out.append(("" if style in (0, 1, 5) else rng.choice("_-/")).join(words))
    return out


def random_samples(n: int, seed: int, alphabet: str) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(20, 48))) for _ in range(n)]


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]


def _fit(samples: list[str], smooth: float) -> np.ndarray:
    """Log probabilities of a character after another (0: the start)."""
    counts = np.full((len(_CHARS) + 1, len(_CHARS) + 1), smooth)
    for x in samples:
        c = np.concatenate(([0], _codes(x)))
        np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


@dataclass
class Models:
    ordinary: np.ndarray
    randoms: list[np.ndarray]

    def ratio(self, text: str) -> float:
        """Log-likelihood of the best random model less that of the ordinary one."""
        c = np.concatenate(([0], _codes(text)))
        return float(max(x[c[:-1], c[1:]].sum() for x in self.randoms) - self.ordinary[c[:-1], c[1:]].sum())


def train(ordinary: list[str], randoms: list[list[str]]) -> Models:
    return Models(_fit(ordinary, 0.5), [_fit(x, 0.05) for x in randoms])


def trained(samples: int = SAMPLES, seed: int = 1) -> Models:
    """Models from ``samples`` labelled samples of each kind."""
    return train(ordinary_samples(samples, seed, public_names()), [random_samples(samples, seed + k, a) for k, a in enumerate(ALPHABETS)])


def _is_key(x: str, models: Models, threshold: float, letters: float) -> bool:
    kinds = [any(f(c) for c in x) for f in (str.isdigit, str.isupper, str.islower)]
    if kinds[0] and (kinds[1] or kinds[2]):
        return models.ratio(x) > threshold
    return kinds[1] and kinds[2] and models.ratio(x) > letters


def _keys(run: re.Match, models: Models, threshold: float, letters: float, shortest: int) -> list[tuple[int, int]]:
    """The run if it is a key; its segments that are, where the others are ordinary or the run isn't."""
    parts = [(run.start() + m.start(), m[0]) for m in re.finditer("[A-Za-z0-9+]+", run[0])]
    keys = [(a, x) for a, x in parts if len(x) >= shortest and _is_key(x, models, threshold, letters)]
    rest = [x for a, x in parts if (a, x) not in keys]
    if _is_key(run[0], models, threshold, letters) and not (keys and all(models.ratio(x) <= 0 for x in rest)):
        return [run.span()]
    return [(a, a + len(x)) for a, x in keys]


def spans(text: str | None, models: Models, threshold: float = THRESHOLD, shortest: int = SHORTEST, letters: float = LETTERS) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans in order."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(x in low for x in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if max(map(len, text.split()), default=0) >= min(shortest, 24):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base = list(found)
        for m in _RUN.finditer(text):
            if len(m[0]) >= shortest and not any(s < m.end() and m.start() < e for s, _, e in base):
                found += [(a, 3, b) for a, b in _keys(m, models, threshold, letters, shortest)]
    return sorted(found)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, models: Models | None = None, threshold: float = THRESHOLD, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    shared = docs.sparkSession.sparkContext.broadcast(models or trained())
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("secrets")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = spans(text.as_py(), shared.value, threshold, shortest)
                n = [sum(k == x for _, k, _ in found) for x in range(4)]
                base = _joined([x for x in found if x[1] < 3])
                rows.append((doc_id, *n[:3], hashlib.sha256(base.encode()).hexdigest(), _joined(found), n[3]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
