"""Secret scans with a random forest that removes false positives.

Candidates are found by patterns over whole texts: keys with a known prefix,
private-key blocks, and long tokens of letters and digits. A random forest
then tells secrets from hashes, ids, paths, numbers and words, by a candidate's
length, the surprise of its character transitions under an English and a hex
model, how much of it dictionary words cover, whether it stands in a path or
url, and the words next to it. It is trained here on labelled findings made by
:func:`labelled_findings` (``TRAIN_ROWS`` of each class, a bound on the
training sample only).

Nulls and odd rows: null and empty texts have no findings; very long texts are
scanned whole; of findings that overlap the first counts, and of those with one
start the longest (then a known format, an assignment, a token, in this order);
repeated rows each report; extra columns are ignored (:func:`redacted` keeps
them); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import Forest

#: Labelled findings of each class that the forest is fitted on.
TRAIN_ROWS = 3000
#: Least probability that makes a finding a secret.
THRESHOLD = 0.5
#: What :func:`redacted` writes in the place of a secret.
MARK = "[redacted-secret]"
#: Characters around a candidate that its neighbouring words are taken from.
AROUND = 60

#: Public formats of keys.
FORMATS = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)"),
    ("aws_access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("github_token", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})"),
    ("slack_token", r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    ("google_api_key", r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}"),
    ("stripe_key", r"(?<![A-Za-z0-9])[srp]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("jwt", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    ("openai_style_key", r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}"),
)
_FORMAT = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in FORMATS))
#: A text without any of these has no key of a known format.
_HINTS = ("PRIVATE KEY", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "AIza", "k_live_", "k_test_", "eyJ", "sk-")
#: Long tokens, of which those with a digit and a letter count; what follows an assignment may be shorter.
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}+")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_ASSIGNED = re.compile(r"(?ia)\b(?:password|passwd|pwd|secret|api[_-]?key|auth[_-]?key|access[_-]?key|private[_-]?key|credential|token)s?\"?\s{0,3}[:=]\s{0,3}[\"']?(?P<value>[^\s\"']{8,})")
_ASSIGN_HINTS = ("pass", "pwd", "secret", "key", "credential", "token")

#: Words near secrets, words near other long tokens, and common parts of identifiers.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api", "auth", "authorization", "bearer", "credential", "credentials", "private", "access", "login", "client")
OTHER_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "etag", "uuid", "guid", "id", "revision", "rev", "version", "build", "file", "path", "url", "href", "src", "image", "img", "example", "sample", "placeholder", "order", "invoice", "isbn", "doi", "card", "phone")
DICTIONARY = ("about access account action admin after album amount android application archive article assets auto back backup banner base before begin beta between black blog body book border bottom branch browser build button cache call camera card category center change channel chapter check child class client close cloud code color column comment commit common company component config connect contact content control copy count country course create custom daily data database date default delete demo design detail device dialog direct disable display document domain down download draft drive east edit element email enable english entry error event example export extra field file filter final first folder font footer form format forum free from full function game gallery general global green group guide handler head header health help high history home host house icon image import index info input install internal item java join journal json label lang language large last layout left level library light line link list live load local location login logo long mail main make manager map master media member menu message mobile model module month more music name network news next node note number object office online open option order original output package page panel parent part partner pass path payment people phone photo picture placeholder plain plan player plugin point policy popular post power press preview price private process product profile project public query question quick random read record release remote report request resource response result review right root route sample save schema school screen script search second section security select send server service session setting share shop short show side sign simple single site size slide small social sort sound source space special staging standard star start state static status step stock store story stream string student style submit success summary support system table task team template test text theme thumb time title token tool topic total track train type unit update upload user util value version video view visit watch water week white widget window word work world write year your zone").split()


def _model(texts: list[str]) -> dict[str, float]:
    """Log probabilities of character transitions, with add-one smoothing over 64 classes."""
    pairs: dict[str, int] = {}
    firsts: dict[str, int] = {}
    for text in texts:
        for a, b in zip(text, text[1:], strict=False):
            pairs[a + b] = pairs.get(a + b, 0) + 1
            firsts[a] = firsts.get(a, 0) + 1
    return {p: math.log((n + 1) / (firsts[p[0]] + 64)) for p, n in pairs.items()}


_ENGLISH = _model([f" {w} " for w in DICTIONARY])
_WORDS = sorted({w for w in DICTIONARY if len(w) >= 3}, key=len, reverse=True)
_COVER = re.compile("|".join(_WORDS))
_PLACE = re.compile(r"(?i)x{4,}|\.\.\.|<[a-z_ ]+>|your[_-]|example|changeme|placeholder|dummy|sample|0{6,}|1234567|abcdef")

FEATURES = ("length", "upper", "lower", "digits", "others", "entropy", "transitions", "switches", "hex", "decimal", "coverage", "known_length", "uuid", "path", "url", "assigned", "quoted", "secret_before", "other_before", "secret_near", "other_near", "placeholder", "prefixed", "longest_letters")


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """The numbers that the forest sees of one candidate."""
    value = text[start:end]
    n = len(value)
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND // 2]
    counts = [sum(map(f, value)) / n for f in (str.isupper, str.islower, str.isdigit)]
    freq = [value.count(c) / n for c in set(value)]
    lower = value.lower()
    moves = [_ENGLISH.get(lower[k : k + 2], math.log(1 / 640)) for k in range(n - 1)]
    kinds = [c.isdigit() + 2 * c.isalpha() for c in value]
    switches = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    covered = sum(len(m.group()) for m in _COVER.finditer(lower)) / n
    hexed = bool(re.fullmatch(r"[0-9a-fA-F]+", value))
    near_before = re.findall(r"[a-z0-9]+", before.lower())
    near_after = re.findall(r"[a-z0-9]+", after.lower())
    last = near_before[-2:]
    glue = before[-3:]
    return [
        n, *counts, 1 - sum(counts), -sum(p * math.log2(p) for p in freq), sum(moves) / max(1, len(moves)), switches,
        float(hexed), float(value.isdigit()), covered, float(hexed and n in (32, 40, 56, 64, 96, 128)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        float("/" in value or before[-1:] in ("/", "\\") or after[:1] in ("/", "\\") or bool(re.match(r"\.[a-z]{2,4}\b", after))),
        float("://" in before[-40:] and not re.search(r"\s", before[before.rfind("://") :])),
        float("=" in glue or ":" in glue), float(glue[-1:] in "\"'`" and glue != ""),
        float(any(w in SECRET_WORDS for w in last)), float(any(w in OTHER_WORDS for w in last)),
        float(any(w in SECRET_WORDS for w in near_before[-6:] + near_after[:3])), float(any(w in OTHER_WORDS for w in near_before[-6:] + near_after[:3])),
        float(bool(_PLACE.search(value))), float(kind not in ("token", "assigned")), max((len(m) for m in re.findall(r"[A-Za-z]+", value)), default=0),
    ]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every candidate of a whole text, in order and without overlaps."""
    found: list[tuple[int, int, str]] = []
    if any(h in text for h in _HINTS):
        found += [(m.start(), m.end(), m.lastgroup or "") for m in _FORMAT.finditer(text)]
    low = text.lower() if any(h in text for h in ("=", ":")) else ""
    if low and any(h in low for h in _ASSIGN_HINTS):
        found += [(m.start("value"), m.end("value"), "assigned") for m in _ASSIGNED.finditer(text)]
    # a token has a digit and 16 characters, so only words that have both are searched
    for word in _DIGIT_WORDS.finditer(text):
        found += [(word.start() + m.start(), word.start() + m.end(), "token") for m in _TOKEN.finditer(word.group()) if _DIGIT.search(m.group()) and _LETTER.search(m.group())]
    out: list[tuple[int, int, str]] = []
    for span in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


#: Tried at the starts of words only, and without going back, so long words without a digit cost no more than their length.
_DIGIT_WORDS = re.compile(r"(?<!\S)(?=\S{16})[^\s0-9]*+[0-9]\S*")


def labelled_findings(n: int, seed: int = 3) -> tuple[list[tuple[str, int, int, str]], np.ndarray]:
    """``n`` secrets and ``n`` other findings in their surroundings, each with a label."""
    rng = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def pick(chars: str, k: int) -> str:
        return "".join(rng.choices(chars, k=k))

    def words(k: int) -> str:
        return " ".join(rng.choices(DICTIONARY, k=k))

    def hexes(k: int) -> str:
        return pick("0123456789abcdef", k) if rng.random() < 0.8 else pick("0123456789ABCDEF", k)

    def secret() -> tuple[str, str, str, str]:
        kind = rng.randrange(8)
        if kind == 0:
            return words(2) + " ", rng.choice(("AKIA", "ASIA")) + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), " ", "aws_access_key"
        if kind == 1:
            return words(2) + " ", "ghp_" + pick(alnum, 36), "\n", "github_token"
        if kind == 2:
            return words(2) + " ", "sk_live_" + pick(alnum, 24), " ", "stripe_key"
        if kind == 3:
            return "authorization: bearer ", "eyJ" + pick(alnum, 24) + "." + pick(alnum, 40) + "." + pick(alnum, 30), " ", "jwt"
        name = rng.choice(("token", "api_key", "apikey", "secret", "password", "access_key", "auth_key", "client_secret", "private_key", "TOKEN", "Secret", "accessKey"))
        sign, quote = rng.choice((" = ", "=", ": ", ":")), rng.choice(('"', "'", '"', ""))
        value = hexes(rng.choice((24, 32, 40, 40, 40, 48, 64))) if kind < 6 else pick(alnum + "+/_-", rng.randint(20, 48))
        if kind == 7 and rng.random() < 0.4:
            value = pick(alnum, 4) + pick("!@#%^&*", 2) + pick(alnum, rng.randint(4, 10))
        close = quote or rng.choice((" ", "\n"))
        return f"{words(rng.randint(1, 4))} {name}{sign}{quote}", value, close, rng.choice(("assigned", "token"))

    def other() -> tuple[str, str, str, str]:
        kind = rng.randrange(11)
        if kind == 0:
            return rng.choice(("commit ", "sha256: ", "md5 ", "checksum = ", "revision ", "digest: ", "etag: ", "build ")), hexes(rng.choice((32, 40, 40, 64))), rng.choice((" ", "\n")), "token"
        if kind == 1:
            h = hexes(32)
            return rng.choice(("id: ", "uuid=", "request ", "guid ", "session ")), f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", " ", "token"
        if kind == 2:
            return "https://" + words(1) + ".example.com/", "/".join(rng.choices(DICTIONARY, k=3)) + f"/{rng.randint(1, 9999)}", ".html ", "token"
        if kind == 3:
            return words(3) + " /usr/" + words(1) + "/", "_".join(rng.choices(DICTIONARY, k=rng.randint(2, 4))) + f"_{rng.randint(0, 99)}", rng.choice((".py ", ".png", " ")), "token"
        if kind == 4:
            return words(3) + " ", pick("0123456789", 16) + rng.choice(DICTIONARY), " ", "token"
        if kind == 5:
            return rng.choice(("token = ", "api_key: ", "password=", "secret = ")), rng.choice(("your_api_key_here1", "xxxxxxxxxxxxxxxx1", "example-token-0000", "changeme12345678", "<insert_key_here_1>", "placeholder_12345", "sample_secret_00000")), " ", "assigned"
        if kind == 6:
            return words(4) + " ", "-".join(rng.choices(DICTIONARY, k=rng.randint(3, 6))) + f"-{rng.randint(1, 2030)}", " ", "token"
        if kind == 7:
            return words(3) + " ", "".join(w.capitalize() for w in rng.choices(DICTIONARY, k=3)) + str(rng.randint(1, 99)), rng.choice(("(", " ", ".")), "token"
        if kind == 8:
            return "src=" + rng.choice(("", '"')) + "data:image/png;base64,", pick(alnum + "+/", rng.randint(60, 120)), '"', "token"
        if kind == 9:
            return words(3) + " ", "=" * rng.randint(8, 20) + "1" + rng.choice(DICTIONARY) + "=" * rng.randint(4, 9), " ", "token"
        return rng.choice(("key: ", "token: ", "password: ", "secret: ")), rng.choice(DICTIONARY) + rng.choice(DICTIONARY) + rng.choice((",", ".", "")), " ", "assigned"

    rows, labels = [], []
    for label, make in ((1, secret), (0, other)):
        for _ in range(n):
            before, value, after, kind = make()
            lead = words(rng.randint(0, 6)) + " " if rng.random() < 0.7 else ""
            text = lead + before + value + after + words(rng.randint(0, 6))
            at = len(lead) + len(before)
            rows.append((text, at, at + len(value), kind))
            labels.append(label)
    return rows, np.array(labels)


@lru_cache(maxsize=1)
def trained() -> Forest:
    rows, labels = labelled_findings(TRAIN_ROWS)
    return Forest().fit(np.array([features(*r) for r in rows]), labels)


def scanned(model: Forest, text: str | None) -> list[tuple[int, int, str, float]]:
    """``(start, end, kind, probability)`` of every candidate of a text."""
    spans = candidates(text) if text else []
    if not spans:
        return []
    p = model.predict(np.array([features(text, *s) for s in spans]))
    return [(*s, float(x)) for s, x in zip(spans, p, strict=True)]


def findings(docs: DataFrame) -> DataFrame:
    """Every candidate of every text: ``doc_id, start, length, kind, probability, secret``; places count code points."""
    model = trained()
    names = ["doc_id", "start", "length", "kind", "probability", "secret"]

    def run(batches):
        for batch in batches:
            rows = [(doc, a, b - a, kind, round(p, 6), p >= THRESHOLD) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b, kind, p in scanned(model, text)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, kind string, probability double, secret boolean")


def redact(model: Forest, text: str | None) -> str | None:
    """A text with every secret replaced by ``MARK``."""
    spans = [s for s in scanned(model, text) if s[3] >= THRESHOLD]
    for a, b, _, _ in reversed(spans):
        text = text[:a] + MARK + text[b:]
    return text


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in the column ``text`` replaced; all other columns and rows stay."""
    model, schema = trained(), docs.schema
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array([redact(model, t) for t in cols[at].to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
