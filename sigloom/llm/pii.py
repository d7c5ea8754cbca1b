"""Personal data: exact base patterns, and more spans that boosted trees pick from high-recall candidates.

Base spans are found by fixed patterns and always stay. Generators then propose further, overlapping spans: addresses with
the at or the dots written out or set apart, every stretch of number groups with as many digits as a card or a phone has,
dotted or bracketed quadruples, and values that may be secrets. Boosted trees score each proposal by its format and its
context, a calibration turns scores into probabilities, and per-kind thresholds select. Of overlapping selections the
likelier one stays; one that touches a base span of any kind is dropped.

The trees learn from a bounded sample of the documents: into each, known data and look-alikes are planted at word borders, and
proposals that are none of the planted data, the documents' own numbers among them, are the wrong ones.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import hash_threshold, map_columns, table
from sigloom.llm.learn import BoostedTrees, fit_logistic, predict

#: The kinds of the base patterns, and one that only the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Every ip, card and phone lies in one such run: a plus sign or a digit, then digits and the marks between them.
RUN = re.compile(r"[+0-9][0-9 ().-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def good_ip(text: str) -> bool:
    return all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in text.split("."))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, in the order of kind and start."""
    email, rest = [], []
    end = 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            low = max(end, text.rfind("@", 0, m.start()) + 1)
            size = len(text[low : m.start()]) - len(text[low : m.start()].rstrip(LOCAL))
            if size:
                email.append((0, m.start() - size, m.end()))
                end = m.end()
    for run in RUN.finditer(text):
        at, whole = run.start(), run[0]
        if len(whole) < 7:
            continue
        if "." in whole:
            rest += [(1, at + m.start(), at + m.end()) for m in IP.finditer(whole) if good_ip(m[0])]
        if len(whole) >= 13:
            for m in CARD.finditer(whole):
                if len(m[0]) >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                    rest.append((2, at + m.start(), at + m.end()))
        if whole[0] == "+" and (m := PHONE.match(whole)) and 9 <= len(digits_of(m[0])) <= 15:
            rest.append((3, at, at + m.end()))
    return sorted(email + rest)


#: Documents of the sample in which data are planted, and own proposals taken from one of them at most.
SAMPLE_DOCS, OWN = 600, 20
#: Proposals that are described and scored together.
BATCH = 4096
#: Words of the context features, by the kind they speak for.
CUES = (
    ("mail", "e-mail", "contact", "write", "reach"),
    ("ip", "host", "server", "address", "login"),
    ("card", "visa", "credit", "pay", "account"),
    ("phone", "tel", "call", "fax", "mobile", "dial", "cell"),
    ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential"),
)
AGAINST = ("order", "version", "isbn", "total", "id", "no", "figure", "page", "year", "date", "price", "table", "commit", "sha", "uuid", "ref")
#: An at, in words, brackets or set apart, then a host; the host may end at any of its dots. And what stands before it.
AT = re.compile(r"(?i)\bat\b|(?<=\s)@|@(?=\s)")
HOST = re.compile(r"(?i)(?:at|@)\s{0,2}[\])}>]?\s{0,2}[a-z0-9-]{2,63}(?:\s{0,2}[\[({<]?\s{0,2}(?:\bdot\b|\.)\s{0,2}[\])}>]?\s{0,2}[a-z0-9-]{2,24}){1,4}")
HOST_END = re.compile(r"(?i)[\[({<]\s{0,2}(?:\bdot\b|\.)\s{0,2}[\])}>]\s{0,2}|\s{1,2}dot\s{1,2}|\.\s{0,2}|\s{1,2}\.\s{0,2}")
#: A mailbox name has at most 64 characters, by the standard.
OWNER = re.compile(r"(?i)(?<![a-z0-9._+-])[a-z0-9][a-z0-9._+-]{0,63}\s{0,2}[\[({<]?\s{0,2}\Z")
DOTTED = re.compile(r"(?i)(?<![0-9])[0-9]{1,3}(?:\s?[\[(]\s?(?:\.|dot)\s?[\])]\s?[0-9]{1,3}|\s?\.\s?[0-9]{1,3}|\s+dot\s+[0-9]{1,3}){3}(?![0-9])")
#: Number groups with at most three marks between them.
NUMBERS = re.compile(r"[0-9]+(?:[ ()._/-]{1,3}[0-9]+)*")
GROUP = re.compile(r"[0-9]+")
ASSIGNED = re.compile(r"(?i)(?:token|secret|passwor[dt]|passwd|pwd|key|auth|bearer|credentials?)\w{0,20}[\"']?\s{0,3}(?:[:=]\s{0,3}|\s)[\"']?([^\s\"',;|]{5,}[^\s\"',;|.:!?])")
MIXED = re.compile(r"[A-Za-z0-9_+/=-]{16,}")


def candidates(text: str, taken: list[Span]) -> list[Span]:
    """Proposals of all kinds, overlapping each other, clear of the spans already taken."""
    out: list[Span] = []
    for m in AT.finditer(text):
        host = HOST.match(text, m.start())
        if host and (owner := OWNER.search(text, max(0, m.start() - 70), m.start())):
            out.append((0, owner.start(), host.end()))
            # A sentence may end inside: every shorter host is a proposal as well.
            out += [(0, owner.start(), cut) for x in HOST_END.finditer(text, m.end(), host.end()) if HOST.fullmatch(text, m.start(), cut := x.start())]
    if any(d in text for d in "0123456789"):
        out += [(1, m.start(), m.end()) for m in DOTTED.finditer(text)]
        for run in NUMBERS.finditer(text):
            if len(run[0]) >= 7:
                out += number_candidates(text, [m.span() for m in GROUP.finditer(text, run.start(), run.end())])
        for m in MIXED.finditer(text):
            if not m[0].isdigit() and GROUP.search(m[0]):
                out.append((4, m.start(), m.end()))
    out += [(4, *m.span(1)) for m in ASSIGNED.finditer(text)]
    taken = sorted(taken, key=lambda s: s[1])
    starts = np.array([s[1] for s in taken])
    tops = np.maximum.accumulate([s[2] for s in taken]) if taken else np.zeros(0)
    free = []
    for kind, start, end in sorted(set(out)):
        before = int(np.searchsorted(starts, end))
        if not before or tops[before - 1] <= start:
            free.append((kind, start, end))
    return free


def number_candidates(text: str, groups: list[tuple[int, int]]) -> list[Span]:
    """Stretches of neighbouring groups with 13 to 19 digits (card) or 7 to 15 (phone)."""
    out = []
    for i, (start, _) in enumerate(groups):
        digits = 0
        for low, end in groups[i:]:
            digits += end - low
            if digits > 19:
                break
            if digits >= 13:
                out.append((2, start, end))
            if 7 <= digits <= 15:
                out.append((3, start - (text[start - 1 : start] in ("(", "+")), end))
    return out


WRITTEN_PARTS = re.compile(r"(?i)([a-z0-9][a-z0-9._+-]*)\s*([\[({<]?)\s*(?:at|@)\s*[\])}>]?\s*[a-z0-9-]+(?:\.[a-z0-9-]+)*\.([a-z0-9-]+)")
DOT_WORD = re.compile(r"(?i)[\[({<]\s*(?:dot|\.)\s*[\])}>]|\sdot\s")

MORE_HOST = re.compile(r"\s{0,2}[\[({<]?\s{0,2}(?:dot\b|\.)\s{0,2}[\])}>]?\s{0,2}[a-z0-9]")
#: Frequent last labels of hosts.
TOPS = frozenset("com org net edu gov info io de fr es it uk eu nl pl ru cn jp br in ch at be se no fi dk cz ca au us biz co me dev app".split())


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a proposal."""
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    groups = GROUP.findall(body)
    d = "".join(groups)
    lengths = [len(g) for g in groups]
    words = set(re.findall(r"[a-z_-]+", before)) | set(re.findall(r"[a-z_-]+", after))
    cue = [float(any(c in words for c in CUES[k])) for k in range(5)]
    joiners = set(re.findall(r"[^0-9A-Za-z]", body))
    parts = WRITTEN_PARTS.fullmatch(body) if kind == 0 else None
    owner = re.match(r"(?i)[a-z0-9._+-]+", body) if kind == 0 else None
    return [
        float(kind), float(len(body)), float(len(d)), float(len(groups)), float(max(lengths, default=0)),
        float(min(lengths, default=0)), float(len(joiners)), float("(" in body), float("-" in body), float("/" in body),
        float(len(d) >= 13 and luhn(d)), float(d.startswith("0")), cue[kind], float(sum(cue)),
        float(any(c in words for c in AGAINST)), float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(bool(re.search(r"[\w.]$", before))),
        float(bool(re.match(r"[\w%]", after))), float(bool(DOT_WORD.search(body))),
        float(kind == 1 and len(groups) == 4 and all(int(g) <= 255 for g in groups)),
        float(lengths in ([3, 3, 4], [1, 3, 3, 4])), float(len(set(lengths)) == 1 and len(lengths) > 1),
        # Plain dots only: a local part with a digit or mark, an at in brackets, a last label of letters. And a dot before a space.
        float(bool(parts and re.search(r"[0-9._+-]", parts[1]))), float(bool(parts and parts[2])),
        float(bool(parts and parts[3].isalpha())), float(bool(parts)), float(bool(re.search(r"\.\s|\s\.", body))),
        # Whether the number groups go on outside, whether a written-out name has marks, and how a secret is mixed.
        float(bool(re.search(r"[0-9][ ()._/-]{0,3}$", before))), float(bool(re.match(r"[ ()._/-]{0,3}[0-9]", after))),
        float(bool(owner and re.search(r"[0-9._+-]", owner[0]))), float(len(re.findall("[A-Z]", body))), float(len(re.findall("[a-z]", body))),
        float(len(set(body)) / max(1, len(body))), float(bool(re.search("[g-zG-Z]", body))), float("@" in body),
        # Whether the host goes on outside, close by or after a mark, and its last label.
        float(bool(re.match(r"\.[a-z0-9]", after))), float(bool(MORE_HOST.match(after))), float(len(label := re.search(r"[^\W_]*\Z", body)[0])),
        float(label.lower() in TOPS),
    ]


def invented(r: random.Random) -> tuple[str, str, int | None]:
    """A piece of text, what stands before it, and its kind; None for a look-alike."""
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("re", "on", "ti", "an", "er", "da", "lo", "mi", "su", "ka")) for _ in range(r.randint(1, 4)))
    code = lambda k, letters="0123456789abcdef": "".join(r.choice(letters) for _ in range(k))
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card() -> str:
        body = num(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(c: str, sep: str) -> str:
        return sep.join(c[i : i + 4] for i in range(0, 16, 4))

    name = r.choice((f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}_{word()}", f"{word()}-{word()}"))
    top = r.choice(("com", "org", "net", "de", "info", "co.uk"))
    host = f"{word()}{r.choice(('', num(1), '-' + word(), '.' + word()))}.{top}"
    closed = r.choice(("[at]", " [at] ", "(at)", " (at) ", " <at> ", "{at}", " [AT] "))
    at, dot = r.choice(((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" AT ", " DOT "), (" @ ", " . "), (" @ ", ".")))
    sep = r.choice("-. ")
    plain = r.choice(("look", "meet", "is", "us", "me", "sold", "stay", "held", word()))
    key = r.choice(("token", "secret", "password", "api_key", "access_key", "key", "auth"))
    wrong = next(x for x in iter(lambda: num(16), None) if not luhn(x))
    cued = lambda k: r.choice(("", f"{r.choice(CUES[k])}{r.choice((':', '', ' me at'))} "))
    good = (
        lambda: (f"{name}{at}{word()}xx{dot}{r.choice(('com', 'org', 'net'))}", cued(0), 0),
        lambda: (r.choice((f"{name}{closed}{host}", f"{word()}{closed}{host}", f"{name} at {host}")), cued(0), 0),
        lambda: (r.choice(("[.]", "(dot)", " [.] ", " . ", " dot ")).join(str(r.randint(1, 255)) for _ in range(4)), cued(1), 1),
        lambda: (grouped(card(), r.choice((".", "/", "_", "  "))), cued(2), 2),
        lambda: (card(), f"{wrong} ", 2),
        lambda: (r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"({num(3)}){sep}{num(3)}{sep}{num(4)}")), cued(3), 3),
        lambda: (f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"{r.choice(CUES[3])}{r.choice((':', '', ' me at'))} ", 3),
        lambda: (code(r.choice((24, 32, 40, 64))), f"{key} {r.choice(('=', ':'))} {r.choice(('', chr(34)))}", 4),
        lambda: (code(r.choice((20, 36, 40)), mixed), f"{key}{r.choice(('=', ': ', ' = ' + chr(39)))}", 4),
    )
    bad = (
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}",
        lambda: f"{num(2)} {num(3)} {num(3)}", lambda: f"{num(3)}-{num(2)}-{num(5)}-{num(2)}", lambda: f"{num(4)}-{num(4)}", lambda: f"{num(2)}.{num(2)}.{num(4)}",
        lambda: f"{num(3)} {num(4)} {num(2)} {num(3)}", lambda: wrong, lambda: grouped(wrong, r.choice("./_ -")), lambda: num(r.randint(7, 15)),
        lambda: f"{plain} at {host}", lambda: f"{plain} at {word()}xx. {word().title()}", lambda: f"{name} at {word()}xx. {word().title()}",
        lambda: f"{plain} at {num(2)}.{num(2)}", lambda: f"{name} at {num(2)}.{num(2)}", lambda: f"{plain} at the {host}", lambda: f"{word()} at {word()} dot {word()}",
        lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)), lambda: f"{code(8)}-{code(4)}-{code(4)}-{code(12)}", lambda: f"{word()}-{word()}-{word()}-{num(4)}",
        lambda: f"{word()}/{word()}/{word()}{num(3)}", lambda: code(40), lambda: f"{key} {word()}{word()}",
    )
    if r.random() < 0.5:
        return r.choice(good)()
    return r.choice(bad)(), r.choice(("", "", r.choice(AGAINST) + r.choice((" ", ": ", " = ")))), None


def planted(text: str, r: random.Random, n: int = 8) -> tuple[str, list[Span], list[tuple[int, int]]]:
    """The text with ``n`` pieces planted at word borders: (text, data, places of all pieces)."""
    borders = [m.start() for m in re.finditer(r"\s", text)]
    where = sorted(r.sample(borders, min(n, len(borders)))) or [len(text)] * n
    out, data, places, at, size = [], [], [], 0, 0
    for border in where:
        body, before, kind = invented(r)
        head = f"{text[at:border]} {before}"
        low = size + len(head)
        tail = (chr(34) if before.endswith(chr(34)) else "'" if before.endswith("'") else "") + r.choice((" ", ". ", ", "))
        out += [head, body, tail]
        size, at = low + len(body) + len(tail), border
        places.append((low, low + len(body)))
        if kind is not None:
            data.append((kind, low, low + len(body)))
    return "".join(out) + text[at:], data, places


#: Dates and versions, which are no phone numbers.
DATED = re.compile(r"(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:19|20)[0-9]{2}|[0-9]{1,3}(?:\.[0-9]{1,3}){2,}")


def proven_wrong(text: str, span: Span) -> bool:
    """Whether a rule shows that a proposal is no data of its kind: a part over 255, a failed checksum, a date or version."""
    kind, start, end = span
    body = text[start:end]
    if kind == 1:
        return any(int(g) > 255 for g in GROUP.findall(body))
    if kind == 2:
        return not luhn("".join(GROUP.findall(body)))
    return kind == 3 and bool(DATED.fullmatch(body))


def examples(text: str) -> tuple[list[list[float]], list[float]]:
    """Features and rightness of the proposals in a text with planted pieces, and of some of its own that are proven wrong.

    Nobody has labelled what the text holds itself: real data there are no examples of either kind.
    """
    r = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    whole, data, places = planted(text, r)
    x, y, own = [], [], []
    for c in candidates(whole, base_spans(whole)):
        if any(c[1] < b and a < c[2] for a, b in places):
            x.append(describe(whole, c))
            y.append(float(c in data))
        elif proven_wrong(whole, c):
            own.append(c)
    for c in r.sample(own, min(OWN, len(own))):
        x.append(describe(whole, c))
        y.append(0.0)
    return x, y


class Picker:
    """Boosted trees, their calibration and the threshold of each kind, from the examples of each text of a sample."""

    #: Precision a kind's threshold has to reach on the texts kept for calibration.
    PRECISION = 0.98

    def __init__(self, found: list[tuple[list[list[float]], list[float]]]):
        self.thresholds = [2.0] * len(KINDS)
        rows = [(f, t, i % 3 == 0) for i, (x, y) in enumerate(found) for f, t in zip(x, y, strict=True)]
        if not any(r[2] for r in rows) or all(r[2] for r in rows):
            return
        x, y, side = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.trees = BoostedTrees(30, 4).fit(x[~side], y[~side])
        raw = self.trees.raw(x[side])
        self.scale = fit_logistic(raw[:, None], y[side], 0.01)
        p, kinds = self.probability(x[side]), x[side][:, 0]
        self.thresholds = [self._threshold(p[kinds == k], y[side][kinds == k]) for k in range(len(KINDS))]

    def _threshold(self, p: np.ndarray, y: np.ndarray) -> float:
        """The lowest threshold, a half at least, from which on enough of the picks are right."""
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
        fit = np.flatnonzero(right >= self.PRECISION)
        return max(0.5, float(p[order][fit[-1]])) if len(fit) else 2.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        return predict(self.scale, self.trees.raw(x)[:, None])

    def pick(self, text: str, taken: list[Span]) -> list[Span]:
        found = candidates(text, taken)
        if not found or min(self.thresholds) > 1:
            return []
        # Some proposals at a time: a text of numbers has several for each of them.
        batches = (found[at : at + BATCH] for at in range(0, len(found), BATCH))
        p = np.concatenate([self.probability(np.array([describe(text, c) for c in batch])) for batch in batches])
        chosen: list[Span] = []
        likely = sorted((-q, c) for q, c in zip(p.tolist(), found, strict=True) if q >= self.thresholds[c[0]])
        busy = np.zeros(len(text) + 1, bool) if likely else None
        for _, c in likely:
            if not busy[c[1] : c[2]].any():
                busy[c[1] : c[2]] = True
                chosen.append(c)
        return chosen


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> Picker:
    """A picker from at most ``sample`` documents, by the hash of the id; of a repeated id the least text counts. Only features reach the driver."""
    known = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("x"))
    limit = hash_threshold(known, "d", sample)
    if limit is None:
        return Picker([])

    def make():
        def run(texts):
            found = [examples(t) for t in texts]
            return [[x for x, _ in found], [y for _, y in found]]

        return run

    chosen = known.where(F.xxhash64("d") <= limit).groupBy("d").agg(F.min("x").alias("x"))
    schema = pa.schema([("f", pa.list_(pa.list_(pa.float64()))), ("y", pa.list_(pa.float64()))])
    rows = map_columns(chosen, ["x"], make, schema, "f array<array<double>>, y array<double>", ["d"])
    found = sorted(((r.f, r.y) for r in rows.collect()), key=lambda r: (len(r[0]), r[0], r[1]))
    return Picker(found)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the earlier one counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def add_spans(docs: DataFrame, picker: Picker, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, base counts per kind, base_sha256, spans, n_added, n_spans and the redacted text of every whole text.

    The counts by kind and the digest are of base spans; ``spans`` lists base and added ones, secrets last. Null counts as
    empty, without spans. Rows that repeat come out as often as they came in; an empty table gives an empty result. Columns of
    ``keep`` may not have the name of an added one.
    """
    model = docs.sparkSession.sparkContext.broadcast(picker)

    def make():
        pick = model.value.pick

        def run(texts):
            rows = []
            for t in texts:
                t = t or ""
                base = base_spans(t)
                more = pick(t, base)
                count = [sum(s[0] == k for s in base) for k in range(4)]
                rows.append([*count, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more), len(base) + len(more), redact(t, base + more)])
            return [list(c) for c in zip(*rows, strict=True)]

        return run

    fields = [(f"n_{k}", pa.int64()) for k in BASE_KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_spans", pa.int64()), ("redacted", pa.string())]
    ddl = ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string, n_added long, n_spans long, redacted string"
    return map_columns(docs, [text], make, pa.schema(fields), ddl, keep)


def op4_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return add_spans(docs, fit(docs)).drop("redacted")
