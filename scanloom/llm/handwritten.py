"""Files that nobody wrote by hand here: generated, minified or bundled, third-party copies, data saved as code.

Three linear support-vector classifiers on hashed features score every row: one on character n-grams of the name and
components of the path, one on character n-grams of the text, and one on character n-grams of each comment line. They
learn from rows that give themselves away (by a generator's header, a conventional name, a body of one pattern).
Headers are masked in what the text classifier sees, so that it must learn from the rest; only the one of
comment lines reads them. A classifier is in doubt within its margin, and beyond as far as it errs on repositories that
are held out from training. Above, a row counts; below, it doesn't, whatever it gives away; in between an exact check of
the same kind of sign decides. The README has the figures.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.plans.spread import spread

BITS = 16
#: About so many rows are labelled by what they give away; the classifiers are fitted on those with a sign and on a share
#: NONE of those without.
SAMPLE = 40_000
NONE = 0.25

# --- evidence ---------------------------------------------------------------

_HEADER = re.compile(
    r"""(?ix) auto-?generated\ file | <auto-?generated> | @generated\b | \bautomatically\ generated\ by | \bgenerated\ by\b.{0,60}(?:do\ not|don't)\ edit
    | code\ generated\ (?:by|from) | \bmachine[- ](?:written|generated)\ by | code\ produced\ from\b.{0,80}hand\ edits | \bstub\ compiler\ from | output\ of\ the\ \w+\ grammar\ compiler
    | do\ not\ (?:edit|modify)\ ?[-–—!.,;:]*\ ?(?:source\ of\ truth|generated|this\ file\ (?:is|was)\ generated) | this\ file\ (?:is|was)\ (?:auto\w*\ )?generated
    | \bvendored\ from\b | \bimported\ unchanged\ from\ upstream | part\ of\ the\ \w+\ library,\ release | ^\W*!\ ?[\w.-]+\ v\d[\w.]*\ \|\ \(c\)
    | copyright\ \(c\)\ [\d,\ -]*\ ?the\ [\w.-]+\ (?:project|library)\ (?:contributors|authors)
    | 本文件为代码生成器输出 | 自动生成[，,]\s*(?:请勿|不要|勿) | 第三方库.{0,40}原样拷贝""",
    re.M,
)
_COMMENT = re.compile(r"^[ \t\ufeff]*(?://|#|/?\*|<!--|--|;)")
_REMARK = re.compile(r"(?m)^[ \t\ufeff]*(?://|#(?!include|define)|/?\*|<!--|--|;|\"\"\"|''').*$")
_CONFIGURATION = re.compile(r"(?i)\.(?:properties|ya?ml|env|conf|cfg|ini|toml|xml|json|config|pem|key|crt|cer|p12|jks|pub)$|^\.env|^id_\w+$|_rsa$|^dockerfile$")
_GENERATED_NAME = re.compile(r"_pb2?(?:_grpc)?\.\w+$|\.pb(?:-c)?\.\w+$|\.(?:generated|gen|g|designer)\.\w+$|(?<=[a-z0-9])Generated\.\w+$|\$\$Gen\.|_autogen\.\w+$|^(?:moc|qrc|ui)_\w+\.\w+$|OuterClass\.\w+$|Grpc\.\w+$|^R\.java$|(?<=\w)_\.java$|\.cached\.\w+$|^compiled_\w+\.\w+$|^lex\.\w+\.\w+$|\.(?:tab|yy)\.\w+$")
_MINIFIED_NAME = re.compile(r"[.-]min\.\w+$|^(?:bundle|chunk|vendor|main|app)[.\-](?:[\w]+\.)?[0-9a-f]{2,}\.\w+$|^\w+-[0-9a-f]*\d[0-9a-f]*\.js$|\.(?:bundle|chunk|pack|packed)\.js$")
_GENERATED_DIR = re.compile(r"(?:^|/)(?:generated(?:-sources|-src|_src)?|__generated__|autogen|obj/gen|build/generated|gen-src)/")
_VENDORED_DIR = re.compile(r"(?:^|/)(?:node_modules|bower_components|site-packages|third[_-]?party|3rdparty|vendor(?:ed)?|external|contrib/imported|deps|static/lib|Pods)/")
_VERSION = re.compile(r"\d+(?:\.\d+)+")


def _library_name(libraries: Sequence[str]):
    names = "|".join(re.escape(x.lower()) for x in sorted(libraries) if x) or r"(?!)"
    return re.compile(rf"^(?:lib)?(?:{names})(?:[-_.]?v?\d[\d.]*|[-_.](?:core|all|min|bundle|dist|full|umd|esm))*\.\w+$")


def path_evidence(name: str, path: str, library) -> bool:
    """The name or place says that the file isn't written here."""
    folder = path[: path.rfind("/") + 1]
    return bool(_GENERATED_NAME.search(name) or _MINIFIED_NAME.search(name) or library.match(name.lower()) or _GENERATED_DIR.search(folder) or _VENDORED_DIR.search(folder))


_NUMBERS = re.compile(r"^[\s\[\]{}()]*(?:array\()?(?:(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?)[\s,;\[\]{}()]*){4,}$")
_RECORD = re.compile(r"""^\s*[\[{(]\s*(?:["'][\w \-]*["']|\w+|-?\d+)\s*(?::|=>|,).*[\]})]\s*,?;?\s*$""")
_RECORD_ARRAY = re.compile(r"""^\s*array\(\s*["']\w+["']\s*=>.*\)\s*,?;?\s*$""")
_BLOB = re.compile(r"[A-Za-z0-9+/]{90,}={0,2}")
_ESCAPES = re.compile(r"(?:\\x[0-9a-fA-F]{2}){8,}")
_WORD = re.compile(r"[A-Za-z_]+")
_DIGITS = re.compile(r"\d+")


def body_evidence(text: str) -> bool:
    """The text is data, or minified, or one pattern repeated with a running number."""
    lines = [x for x in text.splitlines() if x.strip() and not _COMMENT.match(x)]
    total = sum(map(len, lines))
    if total < 80:
        return False
    data = packed = 0
    for line in lines:
        size = len(line)
        if "-----BEGIN" in line:
            continue
        if _NUMBERS.match(line) or _RECORD.match(line) or _RECORD_ARRAY.match(line):
            data += size
        elif size >= 90 and (blob := sum(len(m) for m in _BLOB.findall(line)) + sum(len(m) for m in _ESCAPES.findall(line))) > 0.6 * size:
            data += blob
        elif size >= 200 and sum(c.isspace() for c in line) < 0.09 * size and len(re.findall(r"[;{},()]", line)) > 0.08 * size:
            packed += size
    if (data > 0.6 * total and len(lines) > 2) or data > 0.85 * total or packed > 0.6 * total:
        return True
    if len(lines) < 4:
        return False
    running = 0
    before: tuple[str, int] | None = None
    for line in lines:
        line = " ".join(line.split())
        numbers = _DIGITS.findall(line)
        now = (_DIGITS.sub("#", _WORD.sub("a", line)), int(numbers[0]) if len(numbers[0]) < 300 else 0) if numbers else None
        if now and before and now[0] == before[0] and now[1] == before[1] + 1:
            running += 1
        before = now
    return running >= 3 and running > 0.4 * len(lines)


_SIGNS = ("generated", "vendored", "upstream", "machine", "stub compiler", "hand edits", "grammar compiler", "do not", "don't", "release", "(c)", "代码生成器", "自动生成", "原样拷贝")


def gives_away(text: str) -> bool:
    """A generator's or library's header stands in the text."""
    low = text.lower()
    return any(x in low for x in _SIGNS) and bool(_HEADER.search(text))


def masked(text: str) -> str:
    """The text without comment lines that give it away."""
    return "\n".join(x for x in text.splitlines() if not _HEADER.search(x)) if gives_away(text) else text


# --- features ---------------------------------------------------------------

_SIZES = (3, 4)
_LINE_SIZES = (3, 4, 5)


def _grams(x: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n bytes from each place on, in [0, 2 ** BITS); the last n - 1 places have none."""
    if len(x) < n:
        return np.zeros(0, np.uint32)
    end = len(x) - n + 1
    h = x[:end] * np.uint32(2654435761)
    for k in range(1, n):
        h = (h ^ x[k : end + k]) * np.uint32(16777619)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2654435769)
    return h >> np.uint32(32 - BITS)


def text_features(text: str) -> np.ndarray:
    x = np.frombuffer(masked(text).encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return np.concatenate([_grams(x, n) for n in _SIZES])


_HEX = re.compile(r"(?<![0-9a-zA-Z])(?:(?=[a-f]*\d)[0-9a-f]{4,}|[a-f]{6,})(?![0-9a-zA-Z])")
_START = re.compile(r"\W*[a-zA-Z]+[^a-zA-Z]*")
_END = re.compile(r"(?:[A-Z]?[a-z]*|[A-Z]+|[\x01\x03])[^a-zA-Z]*$")
_LAST_TWO = re.compile(r"(?:[A-Z][a-z]+){2}$")


def _units(name: str, path: str, libraries) -> list[bytes]:
    """What the name and path are made of, the telling parts several times; libraries, versions, hexadecimal numbers and figures
    are one sign each."""

    def plain(s: str) -> str:
        return _DIGITS.sub("9", _HEX.sub("\x03", _VERSION.sub("\x02", libraries.sub("\x01", s))))

    parts = [plain(p) for p in path.split("/")[:-1]]
    name = plain(name)
    body, _, chain = name.partition(".")
    stem = f"^{re.sub(r'[a-z]{4,}', 'w', name)}$"
    words = [w for w in re.split(r"[^a-zA-Z\x01-\x03]+|(?<=[a-z])(?=[A-Z])", name) if w]
    first, last, two = (m[0] if (m := p.search(body)) else "" for p in (_START, _END, _LAST_TWO))
    whole = [*(f"d:{p}" for p in parts), *(f"e:{a}/{b}" for a, b in zip(parts, parts[1:])), f"f:{parts[0] if parts else ''}", *(f"n:{w}" for w in words)]
    ends = [f"x:{chain}", f"b:{first}+{chain}", f"b:{first}", f"l:{last}", f"l:{last}.{chain}", f"m:{two}", f"s:{re.sub(r'[a-zA-Z]+', 'w', body)}.{chain}"]
    return [x.encode("utf-8", "replace") for x in [*whole * 4, *ends * 6, *(stem[k : k + n] for n in (2, 3, 4) for k in range(len(stem) - n + 1))]]


def path_features(name: str, path: str, libraries) -> np.ndarray:
    """N-grams of the name with its ends marked and, several times each, its words, beginning and end, suffixes and the
    path's components and neighbours."""
    return np.array([zlib.crc32(u) >> (32 - BITS) for u in _units(name, path, libraries)], np.uint32)


def remarks(text: str, libraries) -> list[tuple[str, str]]:
    """The comment lines of a text as they are and as they are scored: in lower case, libraries, versions and figures one sign each."""
    found = _REMARK.findall(text)
    return [(x, f"^{_DIGITS.sub('9', _VERSION.sub(chr(2), libraries.sub(chr(1), x.strip()))).lower()}$") for x in found]


def line_features(plain: str) -> np.ndarray:
    x = np.frombuffer(plain.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return np.concatenate([_grams(x, n) for n in _LINE_SIZES])


@dataclass
class Classifier:
    """A linear support-vector classifier on shares of hashed features, in doubt from low to below high."""

    weights: np.ndarray
    bias: float
    low: float = 0.0
    high: float = 0.0
    sizes: tuple[int, ...] = _SIZES

    def score(self, features: np.ndarray) -> float:
        return float(self.weights[features].mean()) + self.bias if len(features) else self.bias

    def counts(self, score: float, sign) -> bool:
        """By the score alone, or by sign() in doubt."""
        return bool(score >= self.high or (score >= self.low and sign()))

    def score_texts(self, texts: list[str]) -> np.ndarray:
        """The score of the n-grams of each text, all at once."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        x = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        total, many = np.zeros(len(raw)), np.zeros(len(raw), np.int64)
        for n in self.sizes:
            sums = np.concatenate([[0.0], np.cumsum(self.weights[_grams(x, n)], dtype=np.float64)])
            here = np.maximum(sizes - n + 1, 0)
            start = np.minimum(np.cumsum(sizes) - sizes, len(sums) - 1)
            total += sums[np.minimum(start + here, len(sums) - 1)] - sums[start]
            many += here
        return np.where(many > 0, total / np.maximum(many, 1), 0.0) + self.bias


def fit(features: list[np.ndarray], labels: np.ndarray, held: np.ndarray, epochs: int = 6, penalty: float = 2e-5, seed: int = 7) -> Classifier:
    """Hinge loss by averaged stochastic steps, both classes of equal weight; low and high from the held-out rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in features:
        at, n = np.unique(f, return_counts=True)
        rows.append((at, (n / max(1, len(f))).astype(np.float64)))
    train = np.flatnonzero(~held)
    share = {True: max(1, labels[train].sum()), False: max(1, (~labels[train]).sum())}
    w, total, b, total_b, steps = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, 0
    pace, t = 60.0, 0
    for epoch in range(epochs):
        for i in rng.permutation(train):
            at, x = rows[i]
            y = 1.0 if labels[i] else -1.0
            t += 1
            rate = pace / (1 + t * penalty * pace)
            if y * (w[at] @ x + b) < 1:
                gain = len(train) / (2 * share[bool(labels[i])])
                w[at] += rate * gain * y * x
                b += 0.002 * gain * y
            if t % 64 == 0:
                w *= 1 - min(0.5, 64 * rate * penalty / 60)
        if epoch >= epochs // 2:
            total += w
            total_b += b
            steps += 1
    model = Classifier((total / steps).astype(np.float32), total_b / steps)
    check = np.flatnonzero(held) if held.any() and len(set(labels[held].tolist())) == 2 else np.arange(len(labels))
    scores = np.array([model.score(features[i]) for i in check])
    good, bad = scores[labels[check]], scores[~labels[check]]
    # Within the margin of 1 a support-vector classifier is in doubt, and as far as it errs on what was held out.
    model.low = float(min([-1.0, *good]))
    model.high = float(np.nextafter(max([1.0, *bad]), np.inf))
    return model


# --- the operator -----------------------------------------------------------

#: A list of names held by every task may have so many; a longer one is refused.
MOST_NAMES = 10_000


def listed(df: DataFrame) -> list[str]:
    """The distinct values of a table of one column of names, all of them; more than MOST_NAMES are an error."""
    rows = df.dropna().distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return [r[0] for r in rows]


def _clean(name: str | None, path: str | None) -> tuple[str, str]:
    path = re.sub(r"/+", "/", (path or "").replace("\\", "/").strip())
    name = (name or "").replace("\\", "/").strip().rsplit("/", 1)[-1] or path.rsplit("/", 1)[-1]
    return name, path if path.endswith(f"/{name}") or path == name else f"{path.rstrip('/')}/{name}".lstrip("/")


@lru_cache(maxsize=4)
def _patterns(libraries: tuple[str, ...]):
    names = "|".join(re.escape(x) for x in libraries) or r"(?!)"
    return _library_name(libraries), re.compile(names, re.I)


def train(rows: DataFrame, libraries: tuple[str, ...], repos: DataFrame | None = None, sample: int = SAMPLE) -> tuple[Classifier, Classifier, Classifier]:
    """The classifiers of path, text and comment lines, fitted on rows out of about `sample` rows (key, name, path, text, repo),
    those of the lowest hash; out of all if there are no more."""
    least = int(NONE * (1 << 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, _ = _patterns(libraries)
        for batch in batches:
            flags = []
            for n, p, t in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                n, p = _clean(n, p)
                flags.append((gives_away(t or ""), path_evidence(n, p, library), body_evidence(t or "")) if not _CONFIGURATION.search(n) else (False, False, False))
            out = pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in flags], pa.bool_()) for k in range(3))], names=["key", "name", "path", "text", "repo", "header", "by_path", "by_body"])
            yield out.filter(pa.array([any(f) or (k >> 8) % (1 << 16) < least for f, k in zip(flags, batch.column(0).to_pylist())], pa.bool_()))

    whole = 1 << 30
    share = min(whole, int(whole * sample / max(1, rows.count())) + 1)
    chosen = rows.select("key", "name", "path", "text", "repo").filter(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(whole)) < share)
    if repos is not None:
        key, name = repos.columns
        of = repos.select(F.col(key).cast("string").alias("repo"), F.col(name).cast("string").alias("of")).dropna().groupBy("repo").agg(F.max("of").alias("of"))
        chosen = chosen.join(of, "repo", "left").select("key", "name", "path", "text", F.coalesce("of", "repo").alias("repo"))
    got = spread(chosen).mapInArrow(run, "key bigint, name string, path string, text string, repo string, header boolean, by_path boolean, by_body boolean").toPandas()
    got = got.drop_duplicates("key").sort_values("key")
    _, names = _patterns(libraries)
    places = [_clean(n, p) for n, p in zip(got["name"], got["path"])]
    held = np.array([zlib.crc32(str(r).encode()) % 5 == 0 for r in got["repo"]], bool)
    head, path, body = (got[c].to_numpy(bool) for c in ("header", "by_path", "by_body"))
    none = ~(head | path | body)
    use = np.flatnonzero(path | none)
    of_path = fit([path_features(*places[i], names) for i in use], path[use], held[use])
    use = np.flatnonzero(body | none)
    of_text = fit([text_features(got["text"].iloc[i] or "") for i in use], body[use], held[use])
    lines = [(plain, bool(_HEADER.search(raw)), held[i]) for i in np.flatnonzero(head | none) for raw, plain in remarks(got["text"].iloc[i] or "", names)]
    of_line = fit([line_features(x) for x, _, _ in lines], np.array([x[1] for x in lines], bool), np.array([x[2] for x in lines], bool))
    of_line.sizes = _LINE_SIZES
    return of_path, of_text, of_line


def not_handwritten(
    df: DataFrame,
    file_col: str,
    name_col: str,
    path_col: str,
    text_col: str,
    repo_col: str,
    libraries: Sequence[str],
    repos: DataFrame | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """(file_col) of the files of which at least one row shows that they aren't written by hand here.

    Files of configuration and keys never come out. Null names, paths and texts show nothing; a null file_col is no file.
    libraries: names of third-party libraries, a short list held by every task; a file named for one is a copy, one
    that only mentions it is not. repos: (value of repo_col, repository), where repo_col is finer. Every row's whole text is scored, in one pass; what is shuffled is file ids.
    An empty df gives no row. Extra columns are not read.
    """
    libraries = tuple(sorted({x.strip().lower() for x in libraries if x and x.strip()}))
    file, name, path, text, repo = (F.col(f"`{c}`") for c in (file_col, name_col, path_col, text_col, repo_col))
    key = F.xxhash64(file, name, path, text)
    rows = df.filter(file.isNotNull()).select(key.alias("key"), file.alias("file"), name.alias("name"), path.alias("path"), text.alias("text"), repo.cast("string").alias("repo"))
    if rows.isEmpty():
        return rows.select(F.col("file").alias(file_col))
    of_path, of_text, of_line = train(rows, libraries, repos, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, names = _patterns(libraries)
        for batch in batches:
            places: dict[tuple, tuple[bool, bool]] = {}
            hit, open_ = [], []
            texts = batch.column(3).to_pylist()
            for i, (n, p, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts)):
                place = places.get((n, p))
                if place is None:
                    name, path = _clean(n, p)
                    config = bool(_CONFIGURATION.search(name))
                    yes = not config and of_path.counts(of_path.score(path_features(name, path, names)), lambda: path_evidence(name, path, library))
                    place = places[n, p] = (config, yes)
                config, yes = place
                if not config and not yes and t:
                    open_.append(i)
                hit.append(yes)
            for a in range(0, len(open_), 256):
                part = open_[a : a + 256]
                lines = [(i, raw, plain) for i in part for raw, plain in remarks(texts[i], names)]
                for (i, raw, _), s in zip(lines, of_line.score_texts([plain for *_, plain in lines]) if lines else ()):
                    hit[i] = hit[i] or of_line.counts(s, lambda: _HEADER.search(raw))
                part = [i for i in part if not hit[i]]
                for i, s in zip(part, of_text.score_texts([masked(texts[i]) for i in part])):
                    hit[i] = of_text.counts(s, lambda: body_evidence(texts[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], names=["file"])

    kind = df.schema[file_col].dataType.simpleString()
    return spread(rows.select("file", "name", "path", "text")).mapInArrow(run, f"file {kind}").distinct().withColumnRenamed("file", file_col)
