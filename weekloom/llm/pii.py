"""Personal data in text, also where it is disguised.

Plain detection looks for e-mail addresses, IPv4 addresses, card numbers and phone numbers. Disguises are undone by
transducers that rewrite a text and record the place of each piece they write and of what it replaces: look-alike
letters and digits of other scripts, "(at)" and "dot" in words or brackets, and spelled digits. The same detectors then
read the normalised text; what they find there is mapped back to source characters, and kept if it is not plain.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import slices, strings

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_FOUR_NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OF_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Look-alikes: Cyrillic, then Greek, then other letters and signs.
_LOOKS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХУІЈЅ", "aeopcyxijsdhqwABEKMHOPCTXYIJS"))
_LOOKS |= dict(zip("οαινρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaivptukABEZHIKMNOPTYX"))
_LOOKS |= dict(zip("ıɡℓ․。．｡＠﹫＋", "igl....@@+"))
_LOOKS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_LOOKS |= {chr(zero + i): str(i) for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
_ONE_FOR_ONE = str.maketrans(_LOOKS)
#: Dashes count as hyphens only where no blank is beside them: between blanks they part sentences and ranges.
_DASH = re.compile(r"(?<=\S)[‐‑–−](?=\S)")
_HIDDEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_UNSEEN = re.compile(f"[{_HIDDEN}]")
_REWRITTEN = frozenset([*_LOOKS, *"‐‑–−", *_HIDDEN])

# The spelled digits of four languages.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_WORD_DIGIT = "|".join(sorted(_SPELLED, key=len, reverse=True))
# The patterns below read texts in lower case. None can match a text in more than a few ways, so that all are linear.
#: Spelled digits count from four in a row on, digits in figures and spelled dots among them.
_DIGIT = rf"(?:{_WORD_DIGIT}|[0-9]++|double (?:{_WORD_DIGIT}))"
_SPELLED_DOT = r"\s(?:dot|point|punkt|punto)\s"
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:\+ ?|plus )?{_DIGIT}(?:(?:[ ,.()-]{{1,3}}+|{_SPELLED_DOT}){_DIGIT}){{3,}}(?!\w)")
_SPELLED_ONE = re.compile(rf"(?<!\w)(?:{_WORD_DIGIT})(?!\w)")
_DOUBLE = re.compile(rf"double ({_WORD_DIGIT})")
_SPELLED_DOTS = re.compile(_SPELLED_DOT)
_OPEN, _SHUT = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_AT = re.compile(rf"{_OPEN}(?:at|@|arroba){_SHUT}|&#0{{0,8}}64;|&#x0{{0,8}}40;|&commat;|%40|\sat\s|\s?-\s?at\s?-\s?|\s@\s|@")
#: What every disguised or plain at has in it, with how far before that the disguise may start.
_AT_CORE = re.compile(r"[\s\[({<-](?:at[\s\])}>-]|arroba[\s\])}>])|@(?=[\s\])}>a-z0-9-])|[&%]")
_REACH = 3
_DOTS = rf"(?:{_OPEN}(?:dot|punkt|punto|point|\.){_SHUT}|&#0{{0,8}}46;|&#x0{{0,8}}2e;|&period;|%2e|\s?-\s?dot\s?-\s?|\s(?:\.|dot|punkt|punto|point)\s)"
_DOT = re.compile(_DOTS)
_DOT_BEFORE = re.compile(rf"{_DOTS}\Z")
_LONGEST_DOT = 16
_OF_NAME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_%+-")
_LABEL = r"(?:[a-z0-9]|-(?!\s?dot\s?-))++"
_DISGUISED_DOMAIN = re.compile(rf"{_LABEL}(?:(?:\.|{_DOTS}){_LABEL})++")
_DISGUISED_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{_DOTS})[0-9]{{1,3}}){{3}}(?![0-9])")
#: Dots that also end or are part of sentences.
_PROSE_DOT = re.compile(r"\s(?:\.|punkt|punto|point)\s")
# Top-level domains, without those that are English words.
_DOMAINS = frozenset(
    """com org net edu gov mil int info biz dev xyz
    ac ad ae af ag ai al ao aq ar au aw ax az ba bb bd bf bg bh bi bj bm bn bo br bs bt bw bz ca cc cd cf cg ch ci ck cl cm cn
    co cr cu cv cw cx cy cz de dj dk dm dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt
    gu gw gy hk hm hn hr ht hu id ie il im io iq ir je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv
    ly ma mc md mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx mz na nc ne nf ng ni nl np nr nu nz om pa pe pf pg ph pk pl pm
    pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm
    tn tr tt tv tw tz ua ug uk uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw""".split()
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern: each @ in turn, with all that may stand before it and a domain after it."""
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _OF_LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            yield a, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Numbers joined by single dots, four by four; their parts are at most 255."""
    for chain in _FOUR_NUMBERS.finditer(text):
        numbers = [*_NUMBER.finditer(text, *chain.span())]
        for i in range(0, len(numbers) - 3, 4):
            four = [m[0] for m in numbers[i : i + 4]]
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield numbers[i].start(), numbers[i + 3].end()


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of plain personal data, leftmost first within each kind, kinds as listed. Linear in the text."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    found += [("ip", a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


class Traced:
    """A text after steps of rewriting; a step keeps the places of what it wrote, in its output and in its input."""

    def __init__(self, text: str, steps: tuple = ()) -> None:
        self.text, self.steps = text, steps

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replace each (start, end, new), which are in order and apart from each other."""
        text = self.text
        if not edits:
            return self
        out, at, size, starts, ends = [], 0, 0, [], []
        for a, b, new in edits:
            out += [text[at:a], new]
            starts.append(size + a - at)
            ends.append(starts[-1] + len(new))
            size, at = ends[-1], b
        return Traced("".join([*out, text[at:]]), (*self.steps, (starts, ends, [e[0] for e in edits], [e[1] for e in edits])))

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of text[a:b]; what was written stands for all that it replaced."""
        for starts, ends, before, after in reversed(self.steps):
            i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
            if i >= 0:
                a = before[i] if a < ends[i] else a - ends[i] + after[i]
            if j >= 0:
                b = after[j] if b - 1 < ends[j] else b - ends[j] + after[j]
        return a, b


def lowered(text: str) -> str:
    """text in lower case, character by character: those whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _name_before(low: str, least: int, end: int) -> int | None:
    """Where the names joined by dots start that end here, not before least; None if there is none."""
    start = None
    while True:
        a = end
        while a > least and low[a - 1] in _OF_NAME:
            a -= 1
        if a == end:
            return start
        start = a
        if a > least and low[a - 1] == ".":
            end = a - 1
        elif m := _DOT_BEFORE.search(low, max(least, a - _LONGEST_DOT), a):
            end = m.start()
        else:
            return start


def _addresses(text: str, low: str) -> Iterator[list[tuple[int, int, str]]]:
    """The edits that make each disguised address a plain one: an at, with names before it and a domain after it.

    "at" as a plain word is prose ("hosted at example.com") unless a disguised dot follows. Dots between blanks and words
    for them also occur in sentences: what follows the last one belongs to the address only if it ends in a top-level
    domain, of one case; the search goes on from where the address is cut.
    """
    done = 0
    for core in _AT_CORE.finditer(low):
        if core.start() < done:
            continue
        places = (_AT.match(low, i) for i in range(max(done, core.start() - _REACH), core.start() + 1))
        m = next((m for m in places if m and m.end() > core.start()), None)
        whole = m and _DISGUISED_DOMAIN.match(low, m.end())
        if not whole or (start := _name_before(low, done, m.start())) is None:
            continue
        end, dots = whole.end(), [*_DOT.finditer(low, *whole.span())]
        while dots and _PROSE_DOT.fullmatch(dots[-1][0]):
            last = text[dots[-1].end() : end].rsplit(".", 1)[-1]
            if last in (last.lower(), last.upper()) and last.lower() in _DOMAINS:
                break
            end = dots.pop().start()
        done = end
        if end < whole.end() and not _DISGUISED_DOMAIN.fullmatch(low, m.end(), end):
            continue
        if m[0].strip(" -\t\n") == "at" and not dots:
            continue
        edits = [(p.start(), p.end(), ".") for p in _DOT.finditer(low, start, m.start())]
        edits += [(*m.span(), "@")] if m[0] != "@" else []
        edits += [(p.start(), p.end(), ".") for p in dots]
        if edits:
            yield edits


def _at_and_dots(t: Traced) -> Traced:
    """Rewrite at and dot disguises, but only within what then reads as an address."""
    low = lowered(t.text)
    found = [*_addresses(t.text, low), *([(p.start(), p.end(), ".") for p in _DOT.finditer(low, *m.span())] for m in _DISGUISED_IP.finditer(low))]
    edits: list[tuple[int, int, str]] = []
    for some in sorted(filter(None, found)):
        if not edits or some[0][0] >= edits[-1][1]:
            edits += some
    return t.rewrite(edits)


def _spelled(t: Traced) -> Traced:
    """Rewrite runs of spelled digits, and of figures with spelled dots, as figures; blanks and marks between them go."""

    def figures(run: str) -> str | None:
        if not (_SPELLED_ONE.search(run) or _SPELLED_DOTS.search(run)):
            return None
        plus = "+" if run.startswith(("+", "plus ")) else ""
        body = _SPELLED_DOTS.sub("\x00", _DOUBLE.sub(lambda d: _SPELLED[d[1]] * 2, run))
        digits = _SPELLED_ONE.sub(lambda d: _SPELLED[d[0]], body)
        return plus + re.sub(r"[^0-9\x00]", "", digits).replace("\x00", ".")

    runs = ((m, figures(m[0])) for m in _SPELLED_RUN.finditer(lowered(t.text)))
    return t.rewrite([(*m.span(), new) for m, new in runs if new is not None])


def deobfuscate(text: str) -> Traced:
    """text after all transducers: look-alikes, then at and dot disguises, then spelled digits."""
    t = Traced(text)
    if not text.isascii() and not _REWRITTEN.isdisjoint(text):
        plain = _DASH.sub("-", text.translate(_ONE_FOR_ONE))
        t = Traced(plain).rewrite([(*m.span(), "") for m in _UNSEEN.finditer(plain)])
    return _spelled(_at_and_dots(t))


def split_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, spans that only the normalised text shows), (kind, start, end) in code points of the source.

    A plain span of the kind may be a part of an added one, but never the whole of it.
    """
    plain = detect(text)
    traced = deobfuscate(text) if text else Traced(text)
    if traced.text == text:
        return plain, []
    added = {(kind, *traced.source(a, b)) for kind, a, b in detect(traced.text)}
    if plain:
        inside = {k: [(a, b) for kind, a, b in plain if kind == k] for k in KINDS}
        starts = {k: [a for a, _ in some] for k, some in inside.items()}

        def covered(kind: str, a: int, b: int) -> bool:
            i = bisect_right(starts[kind], a) - 1  # plain spans of a kind are apart from each other
            return i >= 0 and b <= inside[kind][i][1]

        added = {s for s in added if not covered(*s)}
    return plain, sorted(added)


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain and the added spans of a text, by kind as listed, then start. Time and memory are
    linear in the text: only the places that were rewritten are kept."""
    return sorted({s for some in split_spans(text) for s in some}, key=lambda s: (KINDS.index(s[0]), s[1]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each text; base: whether the plain detectors gave the span."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    for batch in slices(batches):
        found = []
        for text in strings(batch.column(1)):
            plain, added = split_spans(text)
            spans = sorted([*((*s, True) for s in plain), *((*s, False) for s in added)], key=lambda s: (KINDS.index(s[0]), s[1], not s[3]))
            found.append([dict(zip(("kind", "start", "end", "base"), s)) for s in spans])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of docs (doc_id, text). Null text counts as empty; a text without personal data has
    an empty list; rows repeat as in docs; other columns are ignored. No shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    joined = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)
    for batch in slices(batches, 4096):
        every = batch.column(1).to_pylist()
        base = [[s for s in spans if s["base"]] for spans in every]
        counts = [pa.array([sum(s["kind"] == k for s in spans) for spans in base], pa.int64()) for k in KINDS]
        digest = pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([joined(spans) for spans in every], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.mapInArrow(_report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
