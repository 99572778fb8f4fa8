"""Operator 6, secret scans: candidates by shape, false positives removed by a random forest.

Candidates are of two kinds. A run is a maximal run of ASCII letters, digits and ``+/_-.~``, stripped
of points and dashes at its ends, that has 12 characters or more with a digit or with a capital
beyond its first character, or 12 or more after ``Bearer``, or 8 or more after an assignment (``=`` or
``:``, whatever blanks and quotes follow on the line). A quoted value is what stands in quotes after an
assignment, on one line, with no blank, 8 characters or more and at least one that no run has; the runs
in it are no candidates then, and a quoted value that begins in an earlier one isn't one either. So
candidates never overlap.

The forest sees a candidate's length, character classes and their transitions, entropy, dictionary
coverage, the path-like parts of it and the path of its document, what stands about it, and the three
words before and two after it, wherever they are in the text, by their log-odds among the labelled
findings. Candidates that it gives ``threshold`` or more are secrets.

The dictionary is the corpus's own: occurrences of all words in all documents, in 2**20 hashed
counters of fixed size; a substring of 3 to 12 letters counts as a word if it occurs twice and makes up over a
millionth of the words. The findings are a parameter, a list of (text, start, end, path, label) or a
table of such columns, of which at most ``sample`` rows are taken, by hash; without it, a seeded generator
writes secrets and lookalikes of many kinds in context.

Defined results: null and empty texts have no candidate; a null doc_id is reported as null; a
repeated row is reported once; a null or missing path counts as empty; equal candidates in equal
surroundings get equal probabilities, and one at the threshold is a secret; a text of any length is
scanned in whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import random
import re
import string
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm import textvec as tv
from postlake.llm.common import only
from postlake.llm.forest import Forest, grow

THRESHOLD = 0.5
LEAST, LEAST_ASSIGNED = 12, 8
_COUNTER_BITS, _SLICES = 20, 32
_WORD_SHARE = 1e-6
_RUN = tv._table(lambda b: b < 128 and (chr(b).isalnum() or b in b"+/_-.~"))
_EDGE = tv._table(lambda b: b in b".-")
_BLANK = tv._table(lambda b: b in b" \t")
_QUOTE = tv._table(lambda b: b in b"\"'`")
_UPPER = tv._table(lambda b: 65 <= b <= 90)
_SPACE = tv._table(lambda b: b in b" \t\n\r\v\f")
_ASSIGN = tv._table(lambda b: b in b"=:")
_HEX = [tv._table(lambda b, x=x: chr(b) in x) for x in ("0123456789abcdef", "0123456789ABCDEF")]
_LETTER = tv._table(lambda b: b < 128 and chr(b).isalpha())
_DIGIT = tv._table(lambda b: 48 <= b <= 57)
_CLASS = np.array([1 if 48 <= b <= 57 else 2 if 65 <= b <= 90 else 3 if 97 <= b <= 122 else 0 for b in range(256)])
_MOCK = re.compile(r"(?i)test|example|sample|mock|fixture|dummy|demo")

Finding = tuple[str, int, int, str, int]


def _last(data: np.ndarray, offs: np.ndarray, who: np.ndarray, at: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """The last byte before ``at`` in its text that isn't in ``skip``; 0 without one."""
    if not len(at):
        return np.zeros(0, np.uint8)
    seen = np.maximum.accumulate(np.where(skip[data], -1, np.arange(len(data))))
    k = np.where(at > 0, seen[np.maximum(at - 1, 0)], -1)
    return np.where(k >= offs[who], data[np.maximum(k, 0)], 0).astype(np.uint8)


def _total(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(table[data])])


def _quoted(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the quoted values that are candidates."""
    at = np.flatnonzero(_QUOTE[data])
    who = np.searchsorted(offs, at, "right") - 1
    on = _ASSIGN[_last(data, offs, who, at, _BLANK)]
    at, who = at[on], who[on]
    lines = np.append(np.flatnonzero(data == 10), len(data))
    end = np.minimum(offs[who + 1], lines[np.searchsorted(lines, at)]) if len(at) else at
    close = np.full(len(at), len(data))
    for c in b"\"'`":
        same = np.append(np.flatnonzero(data == c), len(data))
        own = data[at] == c
        close[own] = same[np.searchsorted(same, at[own], "right")]
    blanks, runs = _total(_SPACE, data), _total(_RUN, data)
    s, e = at + 1, np.minimum(close, len(data))
    size = e - s
    ok = (close < end) & (size >= LEAST_ASSIGNED)
    ok &= (blanks[np.maximum(e, s)] == blanks[s]) & (runs[np.maximum(e, s)] - runs[s] < size)
    who, s, e = who[ok], s[ok], e[ok]
    outer = s >= np.concatenate([[0], np.maximum.accumulate(e)[:-1]]) if len(s) else np.zeros(0, bool)
    return who[outer], s[outer], e[outer]


def candidates(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the candidates, as bytes of ``data``."""
    s, e, cuts = tv.runs(data, offs, _RUN)
    who = tv.owners(cuts)
    long = e - s >= LEAST_ASSIGNED
    s, e, who = s[long], e[long], who[long]
    # ends are stripped one character a round, as long as any has one to lose
    while len(s) and (cut := (_EDGE[data[s]] & (e > s))).any():
        s = s + cut
        on = e > s
        s, e, who = s[on], e[on], who[on]
    while len(s) and (cut := _EDGE[data[e - 1]]).any():
        e = e - cut
        on = e > s
        s, e, who = s[on], e[on], who[on]
    digits, capitals = _total(_DIGIT, data), _total(_UPPER, data)
    ok = (e - s >= LEAST) & ((digits[e] > digits[s]) | (capitals[e] > capitals[np.minimum(s + 1, e)]))
    ok |= (e - s >= LEAST_ASSIGNED) & _ASSIGN[_last(data, offs, who, s, _BLANK | _QUOTE)]
    bearer = (e - s >= LEAST) & (s - 7 >= offs[who])
    for k, c in enumerate(b"bearer "):
        bearer &= (data[np.maximum(s - 7 + k, 0)] | 32) == c if len(s) else bearer
    ok |= bearer
    who, s, e = who[ok], s[ok], e[ok]
    q_who, q_s, q_e = _quoted(data, offs)
    if len(q_s):
        k = np.searchsorted(q_s, s, "right") - 1
        on = (k < 0) | (s >= q_e[np.maximum(k, 0)])
        who, s, e = (np.concatenate(x) for x in ((who[on], q_who), (s[on], q_s), (e[on], q_e)))
        order = np.argsort(s, kind="stable")
        who, s, e = who[order], s[order], e[order]
    return who, s, e


def _around(data: np.ndarray, offs: np.ndarray, who: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the three words before and the two after each candidate, the nearest first; 0: none."""
    low = data.copy()
    low[_LETTER[data]] |= 32
    ws, we, cuts = tv.runs(data, offs, _LETTER)
    out = np.zeros((len(s), 5), tv.U)
    before, after = np.searchsorted(we, s, "right") - 1, np.searchsorted(ws, e, "left")
    for k, at in enumerate((before, before - 1, before - 2, after, after + 1)):
        on = np.flatnonzero((at >= cuts[who]) & (at < cuts[who + 1]))
        own = at[on]
        out[on, k] = tv.hashes(low, ws[own], we[own])
    return out


def _coverage(data: np.ndarray, s: np.ndarray, e: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The share of each candidate's characters that lie in a word of the dictionary."""
    if not len(s):
        return np.zeros(0)
    size = e - s
    flat = data[tv.ranges(s, size)].copy()
    flat[(flat >= 65) & (flat <= 90)] |= 32
    ends = np.cumsum(size)
    own_end = np.repeat(ends, size)
    letters = np.concatenate([[0], np.cumsum(_LETTER[flat])])
    covered = np.zeros(len(flat) + 1, np.int64)
    begin = np.arange(len(flat))
    for n in range(3, 13):
        at = begin[begin + n <= own_end]
        at = at[letters[at + n] - letters[at] == n]
        if len(at):
            h = tv.hashes(flat, at, at + n)
            at = at[words[(h >> tv.U(64 - _COUNTER_BITS)).astype(np.int64)]]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + n, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    return (inside[ends] - inside[ends - size]) / size


class Scanner:
    """Everything the tasks need: the forest, the neighbours' log-odds and the dictionary's counters."""

    def __init__(self, words: np.ndarray, odds: dict[int, float], forest: Forest | None = None):
        self.words, self.forest = words, forest
        self.names = np.array(sorted(odds), tv.U)
        self.odds = np.array([odds[int(k)] for k in self.names] or [0.0])

    def _odds(self, around: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(around.shape)
        at = np.minimum(np.searchsorted(self.names, around), len(self.names) - 1)
        return np.where(self.names[at] == around, self.odds[at], 0.0)

    def features(self, data: np.ndarray, offs: np.ndarray, who: np.ndarray, s: np.ndarray, e: np.ndarray, paths: list[str]) -> np.ndarray:
        m, n = len(s), e - s
        if not m:
            return np.zeros((0, 27))
        flat, own = data[tv.ranges(s, n)], np.repeat(np.arange(m), n)
        count = lambda on: np.bincount(own[on], minlength=m)
        kind = _CLASS[flat]
        share = np.bincount(own * 4 + kind, minlength=4 * m).reshape(m, 4) / n[:, None]
        inside = np.flatnonzero(own[1:] == own[:-1]) + 1
        steps = np.maximum(n - 1, 1)
        turns = np.bincount(own[inside[kind[inside] != kind[inside - 1]]], minlength=m) / steps
        same = np.bincount(own[inside[flat[inside] == flat[inside - 1]]], minlength=m) / steps
        pairs, times = np.unique(own * 256 + flat, return_counts=True)
        p = times / n[pairs >> 8]
        entropy = np.bincount(pairs >> 8, -p * np.log2(p), m)
        different = np.bincount(pairs >> 8, minlength=m) / np.minimum(n, 64)
        near, sign = _last(data, offs, who, s, _BLANK), _last(data, offs, who, s, _BLANK | _QUOTE)
        then = np.where(e < offs[who + 1], data[np.minimum(e, len(data) - 1)], 0)
        digest = np.ones(m, bool)  # as in sha512-..., which names what it is
        for k, c in enumerate(b"sha"):
            digest &= (data[np.minimum(s + k, len(data) - 1)] | 32) == c
        digest &= (n > 4) & _DIGIT[data[np.minimum(s + 3, len(data) - 1)]]
        around = self._odds(_around(data, offs, who, s, e))
        before, after = around[:, :3], around[:, 3:]
        mock = np.array([bool(_MOCK.search(x or "")) for x in paths])[who]
        return np.stack(
            [
                np.minimum(n, 400), turns, *share.T, entropy, different, _coverage(data, s, e, self.words),
                *[count(flat == c) for c in b"/.-_"], same,
                _QUOTE[near], _ASSIGN[sign], np.isin(near, list(b"/@#&?")), then == ord("@"), _QUOTE[then], digest,
                before[:, 0], before.max(axis=1), before.min(axis=1), after.max(axis=1), after.min(axis=1),
                np.maximum(count(_HEX[0][flat]), count(_HEX[1][flat])) == n, mock,
            ], axis=1,
        ).astype(float)

    def scan(self, data: np.ndarray, offs: np.ndarray, paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        who, s, e = candidates(data, offs)
        return who, s, e, np.round(self.forest.probability(self.features(data, offs, who, s, e, paths)), 6) if len(s) else np.zeros(0)


def _prose(r: random.Random, n: int) -> str:
    part = ["the", "on", "er", "ti", "en", "ver", "la", "que", "los", "mi", "ro", "set", "ing", "al", "da", "new", "val", "is"]
    return " ".join("".join(r.choice(part) for _ in range(r.randint(1, 4))) for _ in range(n))


def labelled_findings(n: int = 6000, seed: int = 11) -> list[Finding]:
    """Half secrets, half lookalikes, each in a text of its own."""
    r = random.Random(seed)
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    some = lambda k, more="": "".join(r.choice(string.ascii_letters + string.digits + more) for _ in range(k))
    word = lambda: r.choice(["user", "config", "order", "page", "item", "value", "report", "theme", "build", "client", "index", "release"])
    names = ["token", "secret", "api_key", "apiKey", "password", "passwd", "access_token", "auth_token", "client_secret", "private_key", "credential", "SECRET_KEY", "aws_secret_access_key"]

    def good() -> tuple[str, str, str]:
        value = r.choice([lambda: hexa(r.choice([32, 40, 40, 64])), lambda: some(r.randint(20, 48)), lambda: base64.b64encode(r.randbytes(r.randint(18, 40))).decode().rstrip("="), lambda: some(r.randint(12, 20), "+-_")])()
        kind = r.random()
        if kind < 0.03:
            return r.choice(["postgres", "mysql", "https", "redis"]) + f"://{word()}:", some(r.randint(10, 24)), f"@{word()}.example.com/{word()}"
        if kind < 0.05:
            return "_authToken=", "npm_" + some(36), ""
        if kind < 0.08:
            q = r.choice(['"', "'"])
            return r.choice(names) + r.choice([" = ", "=", ": "]) + q, some(r.randint(9, 20), "&#!%$^*") + r.choice("&#!%$") + some(3), q
        if kind < 0.11:
            return r.choice(["Authorization: Bearer ", "SECRET_KEY=", "token: "]), "".join(r.choice(string.ascii_letters) for _ in range(r.randint(20, 44))), ""
        if kind < 0.16:
            return r.choice(["", "id ", 'key: "']), "AKIA" + "".join(r.choice(string.ascii_uppercase + "234567") for _ in range(16)), ""
        if kind < 0.22:
            return r.choice(["", "use ", 'token: "']), r.choice(["ghp_", "glpat-", "xoxb-", "sk_live_"]) + some(36), ""
        if kind < 0.28:
            return "Authorization: Bearer ", some(r.randint(24, 60)), ""
        q = r.choice(['"', "'", ""])
        return r.choice(names) + r.choice([" = ", "=", ": "]) + q, value, q

    def bad() -> tuple[str, str, str]:
        return r.choice(
            [
                lambda: (r.choice(["commit ", "revision ", "merge of ", "sha1: ", "md5 = ", "checksum: ", "etag: ", "digest = \"", "blob "]), hexa(r.choice([32, 40, 64])), ""),
                lambda: (r.choice(["id ", "", "uuid: ", "request = "]), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", ""),
                lambda: (r.choice(["", "card ", "call ", "in the ", "order: "]), "".join(r.choice(string.digits) for _ in range(r.randint(12, 20))), ""),
                lambda: (r.choice(["see http://", "https://", "at "]), f"www.{word()}{r.randint(1, 99)}.example.com/{word()}/{word()}{r.randint(1, 999)}.html", ""),
                lambda: (r.choice(["", "in ", "path = ", "file: "]), f"/{word()}/{word()}/{word()}_{r.randint(1, 99)}.{r.choice(['py', 'txt', 'log', 'xml'])}", ""),
                lambda: (r.choice(["", "call ", "var "]), f"{word()}{word().title()}{word().title()}{r.randint(1, 9)}", ""),
                lambda: (r.choice(names) + r.choice([" = ", ": "]) + '"', r.choice(["your_token_here_1", "changeme123456", "xxxxxxxxxxxxxxxx1", "example_key_0000000", "<token12345678", "000000000000000000000000", "replace_with_secret_1", "os.environ.get", "config.secret_value"]), '"'),
                lambda: (r.choice(names) + " = ", f"{word()}_{word()}_{word()}", ""),
                lambda: (r.choice(["released ", "on ", "version: ", "at "]), f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}.{r.randint(1000, 9999)}", ""),
                lambda: ("", f"{_prose(r, 1)}.{r.randint(0, 99)}.{word()}.{word()}", "@mail.example.com"),
                lambda: ("data:image/png;base64,", base64.b64encode(r.randbytes(r.randint(30, 90))).decode(), ""),
                lambda: ('integrity="', r.choice(["sha256-", "sha384-", "sha512-"]) + base64.b64encode(r.randbytes(r.choice([32, 48, 64]))).decode().rstrip("="), '"'),
                lambda: (r.choice(["", "the ", "call "]), "".join(word().title() for _ in range(r.randint(2, 4))), "()"),
                lambda: (r.choice(["", "in "]), "".join(_prose(r, 4).split())[:28].upper() + "XX", ""),
                lambda: (r.choice(["message: ", "title = ", "href="]) + '"', r.choice([f"{word()},{word()}!", f"http://{word()}.example.com/?{word()}={r.randint(1, 99)}&x", "%Y-%m-%d_%H:%M", f"#{word()}>{word()}({r.randint(1, 9)})", f"${{{word()}.{word()}}}"]), '"'),
                lambda: (r.choice(["color: ", "width = ", "label: "]), "".join(_prose(r, 3).split())[:30] + str(r.randint(0, 9)), ""),
            ]
        )()

    out = []
    while len(out) < n:
        label = len(out) % 2
        before, value, after = good() if label else bad()
        lead = _prose(r, r.randint(0, 14))
        head = lead + r.choice([" ", " ", "\n", ". "]) * bool(lead) + before
        text = head + value + after + r.choice([" ", "\n", ". ", ", "]) + _prose(r, r.randint(0, 10))
        out.append((text, len(head), len(head) + len(value), r.choice(["", "src/app.py", "notes.txt", "tests/fixtures.py", "web"]), label))
    return out


def _found(findings: list[Finding]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The candidates of the findings' texts that overlap the finding: (finding, start, end, data, offsets)."""
    texts = [f[0].encode() for f in findings]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    who, s, e = candidates(data, offs)
    a = np.array([offs[k] + len(f[0][: f[1]].encode()) for k, f in enumerate(findings)], np.int64)
    b = np.array([offs[k] + len(f[0][: f[2]].encode()) for k, f in enumerate(findings)], np.int64)
    hit = (s < b[who]) & (e > a[who])
    return who[hit], s[hit], e[hit], data, offs


def train(findings: list[Finding], words: np.ndarray, seed: int = 5) -> Scanner:
    who, s, e, data, offs = _found(findings)
    label = np.array([f[4] for f in findings])[who] if len(who) else np.zeros(0, int)
    if not len(label) or label.min() == label.max():
        raise ValueError("findings of both kinds are needed")
    around = _around(data, offs, who, s, e)
    # how many candidates of either label each word stands next to
    pairs = np.unique(np.stack([np.repeat(np.arange(len(s)), 5).astype(tv.U), around.ravel()], axis=1), axis=0)
    pairs = pairs[pairs[:, 1] > 0]
    names, which = np.unique(pairs[:, 1], return_inverse=True)
    one = np.bincount(which, label[pairs[:, 0].astype(np.int64)], len(names))
    none = np.bincount(which, minlength=len(names)) - one
    n1, n0 = int(label.sum()), int((1 - label).sum())
    odds = np.log((one + 1) / (n1 + 2)) - np.log((none + 1) / (n0 + 2))
    often = one + none >= 20
    scanner = Scanner(words, dict(zip(names[often].tolist(), odds[often].tolist())))
    scanner.forest = grow(scanner.features(data, offs, who, s, e, [f[3] for f in findings]), label, seed=seed)
    return scanner


def findings_of(table: DataFrame, sample: int = 20_000, seed: int = 5) -> list[Finding]:
    """At most ``sample`` labelled findings of a table (text, start, end, path, label), by a seeded hash."""
    t = only(table, text="text", a="start", b="end", path="path", label="label").where("text is not null and a is not null and b is not null and label is not null")
    rows = t.orderBy(F.xxhash64(F.lit(seed), "text", "a", "b"), "text", "a", "b", "label").limit(sample).collect()
    return [(r.text, int(r.a), int(r.b), r.path or "", int(r.label)) for r in rows]


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << _COUNTER_BITS, np.int64)
    for batch in batches:
        for _, _, data, offs in tv.pieces(tv.column(batch, 0), lower=True):
            h, s, e, _ = tv.words(data, offs, _LETTER)
            h = h[e - s >= 3]
            counts += np.bincount((h >> tv.U(64 - _COUNTER_BITS)).astype(np.int64), minlength=len(counts))
    if counts.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES, dtype=np.int32)), pa.array([x.astype("<i8").tobytes() for x in counts.reshape(_SLICES, -1)], pa.binary())], ["slice", "counts"])


def _add_up(group):
    return pa.table([group.column("slice").slice(0, 1), pa.array([sum(np.frombuffer(b, "<i8") for b in group.column("counts").to_pylist()).tobytes()], pa.binary())], ["slice", "counts"])


def dictionary(docs: DataFrame) -> np.ndarray:
    """Which of 2**20 counters hold a word: counted over all documents, of a size that is fixed."""
    src = only(docs, text="text").where("text is not null")
    rows = src.mapInArrow(_word_batches, "slice int, counts binary").groupBy("slice").applyInArrow(_add_up, "slice int, counts binary").collect()
    total = np.zeros(1 << _COUNTER_BITS, np.int64)
    for r in rows:
        total.reshape(_SLICES, -1)[r.slice] = np.frombuffer(bytes(r.counts), "<i8")
    return total > max(1, total.sum() * _WORD_SHARE)


def _scan_batches(batches: Iterator[pa.RecordBatch], scanner, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("path").to_pylist()
        for i, j, data, offs in tv.pieces(tv.column(batch, "text")):
            who, s, e, p = scanner.value.scan(data, offs, paths[i:j])
            ok = p >= threshold
            who, s, e, p = who[ok], s[ok], e[ok], p[ok]
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # offsets in characters
            base = chars[offs[who]]
            values = [data[a:b].tobytes().decode() for a, b in zip(s, e)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).take(pa.array(who)), pa.array(chars[s] - base), pa.array(chars[e] - base), pa.array(values, pa.string()), pa.array(p)], ["doc_id", "start", "end", "secret", "probability"])


def secrets(docs: DataFrame, findings: list[Finding] | DataFrame | None = None, path: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, secret, probability): the secrets, with offsets in characters."""
    if isinstance(findings, DataFrame):
        findings = findings_of(findings)
    scanner = docs.sparkSession.sparkContext.broadcast(train(labelled_findings() if findings is None else findings, dictionary(docs)))
    names = {"doc_id": "doc_id", "text": "text"} | ({"path": path} if path else {})
    src = only(docs, **names).where("text is not null")
    src = src.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (F.col("path").cast("string") if path else F.lit("")).alias("path"))
    return src.mapInArrow(partial(_scan_batches, scanner=scanner, threshold=threshold), "doc_id bigint, start bigint, end bigint, secret string, probability double").distinct()
