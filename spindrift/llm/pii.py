"""Personal data by a semi-Markov conditional random field.

Four patterns give the base spans, which always stay. A semi-Markov model adds further ones: it scores whole candidate
spans by features that no token has by itself (digit sums, group lengths, cue words), and a dynamic program over spans
of bounded length chooses boundaries and kinds together. It is fitted to likelihood, on windows of the corpus labelled
by the base patterns and on generated windows with other spellings and with look-alikes.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import shipped

KINDS = ("email", "ip", "card", "phone")
#: Tokens that a span may have at most.
LONGEST = 24
#: Documents whose windows the model is fitted to, about, and windows taken of each at most.
SAMPLE, WINDOWS = 3_000, 5
#: Characters around a digit or @ that belong to a window; windows that are longer than this in all are not trained on.
AROUND, TRAINED = 40, 400

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """The pattern's leftmost matches from each @ backwards: linear where scanning forwards is quadratic."""
    last, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; code points, end exclusive."""
    if not text or not _ANY.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(m[0].count(c) for c in "0123456789") <= 15:
            out.append(("phone", *m.span()))
    return out


# The model

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)
_EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+(?:@|\s?[\[(]at[\])]\s?)[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]dot[\])]\s?)[A-Za-z0-9-]+)+")
_PHONE_CHARS, _CARD_CHARS = frozenset("+0123456789 ().-/"), frozenset("0123456789 -.")
_CUES = {
    "email": {"mail", "email", "e", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "from"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "ring"},
}
_DATE = re.compile(r"[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4}")


def windows(text: str):
    """(start, end) of the stretches around digits and @ signs, cut at line ends."""
    found = None
    for m in re.finditer(r"[0-9@]+|[\[(]at[\])]", text):
        low = max(m.start() - AROUND, text.rfind("\n", max(0, m.start() - AROUND), m.start()) + 1, 0)
        cut = text.find("\n", m.end(), m.end() + AROUND)
        high = cut if cut >= 0 else min(len(text), m.end() + AROUND)
        if found and low <= found[1]:
            found = (found[0], max(found[1], high))
        else:
            if found:
                yield found
            found = (low, high)
    if found:
        yield found


def features(kind: str, span: str, cue: bool, before: str, after: str) -> list[str]:
    """What the score of a whole span depends on."""
    d = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    out = ["bias", f"cue={cue}"]
    if kind == "email":
        out += [f"at={'@' in span}", f"wide={' ' in span}"]
    elif kind == "ip":
        out += [f"octets={all(len(g) <= 3 and int(g) <= 255 for g in groups)}", f"lead={any(len(g) > 1 and g[0] == '0' for g in groups)}"]
    else:
        out += [f"digits={len(d)}", f"luhn={luhn(d)}", f"groups={min(len(groups), 6)}", f"date={bool(_DATE.fullmatch(span))}", f"dots={'.' in span}"]
        if kind == "phone":
            out += [f"plus={span[0] == '+'}", f"zero={span[0] == '0'}", f"parens={'(' in span}", f"last={min(len(groups[-1]), 5)}", f"one={len(groups) == 1}"]
        else:
            out += [f"even={len({len(g) for g in groups[:-1]}) <= 1}"]
    out.append(f"next={'sign' if after in '%$€£#/:' and after else 'end' if not after else 'other'}")
    out.append(f"prev={'sign' if before and before in '$€£#/:-.,' else 'other'}")
    return [f"{kind}:{x}" for x in out]


def candidates(text: str) -> tuple[int, list[tuple[int, int, int, int, str, list[str]]]]:
    """Number of tokens, and (token i, token j, start, end, kind, features) of every span that could be personal data."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    kinds = [text[a] for a, _ in spans]
    out = []
    alnum = lambda i: 0 <= i < len(text) and text[i].isalnum()
    for i, (start, _) in enumerate(spans):
        c = kinds[i]
        if alnum(start) and alnum(start - 1):
            continue
        digit, letter = "0" <= c <= "9", c.isascii() and c.isalpha()
        if not (digit or letter or c in "+("):
            continue
        cues = None

        def offer(j, end, kind):
            nonlocal cues
            if cues is None:
                cues = set(re.findall(r"[^\W\d_]+", text[max(0, start - 25) : start].lower())[-3:])
            out.append((i, j, start, end, kind, features(kind, text[start:end], bool(cues & _CUES[kind]), text[start - 1 : start], text[end : end + 1])))  # noqa: B023

        if letter or digit:
            end = spans[min(len(spans), i + LONGEST) - 1][1]
            m = _EMAIL_SHAPE.match(text, start, end)
            if m and (start == 0 or text[start - 1] not in _LOCAL) and not alnum(m.end()):
                j = next((j for j in range(i, min(len(spans), i + LONGEST)) if spans[j][1] == m.end()), None)
                if j is not None:
                    offer(j + 1, m.end(), "email")
        if letter:
            continue
        n = 0
        for j in range(i, min(len(spans), i + LONGEST)):
            a, b = spans[j]
            x = text[a]
            if x not in _PHONE_CHARS or x == "+" and j > i:
                break
            if not "0" <= x <= "9":
                continue
            n += b - a
            if n > 19:
                break
            if alnum(b):
                continue
            part = text[start:b]
            if digit and part.count(".") == 3 and re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", part):
                offer(j + 1, b, "ip")
            if digit and n >= 13 and all(y in _CARD_CHARS for y in part):
                offer(j + 1, b, "card")
            if 7 <= n <= 15:
                offer(j + 1, b, "phone")
    return len(spans), out


def _by_end(found):
    ends: dict[int, list] = {}
    for c in found:
        ends.setdefault(c[1], []).append(c)
    return ends


class Model:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def value(self, feats: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in feats)

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        """The best set of spans of a window: best sums up to each token, then backwards."""
        n, found = candidates(text)
        ends = _by_end(found)
        best, via = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for c in ends.get(j, ()):
                s = best[c[0]] + self.value(c[5])
                if s > best[j]:
                    best[j], via[j] = s, c
        out, j = [], n
        while j:
            c = via[j]
            if c:
                out.append((c[4], c[2], c[3]))
                j = c[0]
            else:
                j -= 1
        return out[::-1]

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """Base spans and those the model adds clear of them, by kind, then start."""
        if not text:
            return []
        out = base_spans(text)
        if _ANY.search(text) or "at" in text:
            taken = sorted((a, b) for _, a, b in out)
            for low, high in windows(text):
                for kind, a, b in self.decode(text[low:high]):
                    a, b = a + low, b + low
                    if not any(x < b and a < y for x, y in taken):
                        out.append((kind, a, b))
        return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def train(labelled: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 25, rate: float = 0.3, ridge: float = 0.002) -> Model:
    """Gradient ascent on the log likelihood of the labelled spans of each window, with a step size for each weight."""
    data = []
    for text, gold in labelled:
        n, found = candidates(text)
        if found:
            data.append((n, _by_end(found), [(c, (c[4], c[2], c[3]) in set(gold)) for c in found]))
    model = Model({})
    w, seen = model.weights, {}
    rng = random.Random(7)
    for _ in range(epochs):
        rng.shuffle(data)
        for n, ends, marked in data:
            score = {id(c): model.value(c[5]) for c, _ in marked}
            a = [0.0] * (n + 1)
            for j in range(1, n + 1):
                terms = [a[j - 1], *[a[c[0]] + score[id(c)] for c in ends.get(j, ())]]
                top = max(terms)
                a[j] = top + math.log(sum(math.exp(t - top) for t in terms))
            b = [0.0] * (n + 1)
            starts: dict[int, list] = {}
            for c, _ in marked:
                starts.setdefault(c[0], []).append(c)
            for i in range(n - 1, -1, -1):
                terms = [b[i + 1], *[b[c[1]] + score[id(c)] for c in starts.get(i, ())]]
                top = max(terms)
                b[i] = top + math.log(sum(math.exp(t - top) for t in terms))
            for c, is_gold in marked:
                step = float(is_gold) - math.exp(min(0.0, a[c[0]] + score[id(c)] + b[c[1]] - a[n]))
                if abs(step) > 1e-4:
                    for f in c[5]:
                        g = step - ridge * w.get(f, 0.0)
                        seen[f] = seen.get(f, 1e-2) + g * g
                        w[f] = w.get(f, 0.0) + rate * g / math.sqrt(seen[f])
    return model


def generated(n: int = 600, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows with personal data in spellings that the base patterns miss, and with look-alikes."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))

    def card(k, valid):
        d = rng.choice("3456") + num(k - 2)
        return next(d + x for x in "0123456789" if luhn(d + x) == valid)

    def grouped(d, sep):
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    makers = [
        (lambda: f"({num(3)}) {num(3)}-{num(4)}", "phone"),
        (lambda: f"{rng.randint(200, 999)}-{num(3)}-{num(4)}", "phone"),
        (lambda: f"00{rng.randint(20, 99)} {num(3)} {num(4)} {num(2)}", "phone"),
        (lambda: f"0{num(3)} {num(3)} {num(4)}", "phone"),
        (lambda: f"+{rng.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", "phone"),
        (lambda: f"{word()} [at] {word()} [dot] com", "email"),
        (lambda: f"{word()}(at){word()}.example.org", "email"),
        (lambda: f"{word()}.{word()}{num(2)}@{word()}.example.com", "email"),
        (lambda: grouped(card(16, True), rng.choice(" -.")), "card"),
        (lambda: card(16, True), "card"),
        (lambda: card(15, True), "card"),
        (lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "ip"),
        (lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", None),
        (lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}", None),
        (lambda: card(16, False), None),
        (lambda: grouped(card(16, False), " "), None),
        (lambda: f"978{num(10)}", None),
        (lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", None),
        (lambda: num(rng.randint(7, 12)), None),
        (lambda: f"{num(3)}.{num(3)}.{num(3)}", None),
        (lambda: f"{rng.randint(1, 99)} {num(3)} {num(3)}", None),
        (lambda: f"{rng.randint(300, 999)}.{rng.randint(256, 999)}.{num(3)}.{num(2)}", None),
        (lambda: f"{rng.randint(1990, 2020)}-{rng.randint(1990, 2030)}", None),
        (lambda: " ".join(str(rng.randint(1, 400)) for _ in range(rng.randint(3, 8))), None),
        (lambda: "".join(rng.choice("0123456789abcdef") for _ in range(36)), None),
    ]
    out = []
    for i in range(n):
        make, kind = makers[i % len(makers)]
        body = make()
        cue = f"{rng.choice(sorted(_CUES[kind]))} " if kind and rng.random() < 0.3 else ""
        head = f"{word()} {word()} {cue}"
        out.append((f"{head}{body} {word()} {word()}", [(kind, len(head), len(head) + len(body))] if kind else []))
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a corpus (doc_id, text): from windows of about `sample` of its documents and the generated ones."""
    n = shipped(docs).count()
    # By row, so that a doc_id with very many texts brings no more than others; equal windows are folded.
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("pii")), F.lit(1 << 20)) / float(1 << 20)
    chosen = docs.where((place < min(1.0, sample / max(1, n))) & F.col("text").rlike("[0-9@]")).select("text")

    def cut(batches):
        for b in batches:
            found = [t[a:z] for t in b.column(0).to_pylist() for a, z in [w for w in windows(t) if w[1] - w[0] <= TRAINED][:WINDOWS]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["w"])

    seen = sorted(r.w for r in chosen.mapInArrow(cut, "w string").distinct().collect())
    return train([(w, base_spans(w)) for w in seen] + generated())


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind; spans that overlap are replaced as one, by the first's kind."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op5(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of documents (doc_id, text).

    The counts are of base spans. Null and empty texts have no spans. Repeated rows repeat; an empty table gives an
    empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def run(batches):
        own = held.value
        for b in batches:
            base, spans = [], []
            for t in b.column(1):
                t = t.as_py()
                base.append(base_spans(t))
                spans.append(joined(own.spans(t)))
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *counts, pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string()), pa.array(spans, pa.string())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents with the same columns, personal data in `text` replaced and n_chars, if there, brought up to date."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        own = held.value
        return pd.Series([redacted(t, own.spans(t)) for t in texts], dtype=object)

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


