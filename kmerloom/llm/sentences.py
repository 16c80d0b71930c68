"""Sentence boundaries across languages and scripts, by a semi-Markov dynamic programme over whole spans.

Places where a sentence could end are found by one pattern (terminators with the closing marks behind them; white space
between Thai letters). A segmentation of a paragraph is a chain of spans from one such place to another, and the chain of best
total score is taken. A span's score sums its opening words, its closing word and marks, its length, and what it leaves
unbalanced: a quotation or bracket that begins in the span and ends after it, or the other way round, costs once for the span.
So cutting a quotation at one place spoils both spans, whereas marks that enclose many sentences, as stray ones do, don't hold
them together: the spans between are balanced. No place is left out beforehand and spans may be of any length. Beyond
``FLAT`` letters the length's score is linear, so the best start of a long span is a running maximum for every quotation that
is open, and a paragraph takes time in proportion to its places. Scores are log-odds set by hand: there are no
labelled sentences to fit them to.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kmerloom.llm.mail import paragraphs

# Abbreviations by how they behave before a period, lower case.
#: Titles and the like, which go on.
NEVER = frozenset(
    "dr dra mr mrs ms prof profa hr fr herr frau sr sra srta st mt ing mme mlle lic hon rev gen col capt sgt d.ª ud uds vd проф акад им г-н г-жа "
    "mio mrd e.g i.e cf vs approx ca incl excl ed eds éd bzw evtl ggf vgl z.b d.h u.a sog bspw inkl p.ex p.ej ej ex aprox av env resp viz esp avda π.χ βλ см напр тыс млн млрд ул д-р".split()
)
#: Before a number they go on; else they may end a sentence.
REFERENCE = frozenset(
    "fig figs no nos p pp vol eq tab sec art ch chap abb nr str kap núm pág págs nº n° рис стр кв гл табл σελ αρ jan feb mar apr jun jul aug sep sept oct nov dec dept ave".split()
)
#: They may end a sentence.
ENDABLE = frozenset("etc usw ltd corp inc co jr sr bros a.m p.m al u.s др г гг κ.λπ κλπ إلخ ecc bros".split())
#: Words before an ordinal number of a language that writes it with a period.
BEFORE_ORDINAL = frozenset("am im vom zum beim der dem den des die das bis seit ab und bzw. zur jeder jeden".split())
SPEECH = frozenset("asked said wrote replied added answered fragte sagte meinte rief demanda dit demandait répondit preguntó dijo respondió сказал сказала спросил спросила ρώτησε είπε".split())

_MARKS = ".!?…؟۔።፧।॥"
_CLOSE = "\"'”’»›)\\]}“‘"
_CJK_CLOSE = "」』”’）)】》〉»\"'"
_ENDS = re.compile(
    rf"(?P<cjk>[。！？｡][。！？｡!?]*[{_CJK_CLOSE}]*)"
    rf"|(?P<plain>(?:[{_MARKS}]+|(?<=[Ͱ-Ͽἀ-῿]);)(?:\s?»|[{_CLOSE}])*)(?=\s)"
    r"|(?P<thai>[฀-๿])(?=\s+[฀-๿])"
)
_QUOTES = re.compile(r"[\"“”„«»‘’'「」『』（）()\[\]‹›]")
_PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]"}
_CLOSERS = {"”": "“„", "“": "„", "»": "«", "›": "‹", "’": "‘'", "」": "「", "』": "『", "）": "（(", ")": "(（", "]": "["}
_OPENING = "\"“„«‘'¿¡(‹「『（["
_TOKEN = re.compile(r"[^\s\"“„«‘(\[¿¡]*$")
_TAG = re.compile(r"(?:\w+\s+)?(\w+)[.,]")  # "..." Ann said.
_CAMEL = re.compile(r"[a-zà-ÿ]{1,2}[A-Z]")
_UNCASED = re.compile(r"[֐-ࣿऀ-෿฀-࿿ሀ-፿぀-ヿ㐀-鿿가-힯]")
_LETTER = re.compile(r"\w")
_MOJIBAKE = re.compile(r"[Â-ô][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,3}")
_LIST_NUMBER = re.compile(r"\s*(?:[*•-]\s+)?\d{1,3}$")
#: A length up to which spans of a few letters or more are equally likely; beyond it, the loss a letter.
FLAT, SLOPE = 250, 0.002
#: What a span loses for a quotation or bracket with one end inside it.
UNBALANCED = 12.0
_MISS = -8.0


def repaired(text: str) -> tuple[str, list[int] | None]:
    """Text whose UTF-8 was read as one byte a letter, read anew; and where each letter ends in the old text."""
    if not _MOJIBAKE.search(text):
        return text, None
    out, ends, at = [], [], 0
    for m in _MOJIBAKE.finditer(text):
        raw = m[0]
        for n in range(len(raw), 1, -1):
            try:
                new = b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in raw[:n]).decode("utf-8")
            except UnicodeError:
                continue
            if len(new) == 1:
                out.append(text[at : m.start()] + new)
                ends += [*range(at, m.start()), m.start() + n - 1]
                at = m.start() + n
                break
    out.append(text[at:])
    ends += range(at, len(text))
    return "".join(out), ends


def quote_pairs(text: str) -> list[tuple[int, int]]:
    """(opening, closing) of quotations and brackets; unmatched marks and apostrophes are left out."""
    stack: list[tuple[str, int]] = []
    pairs = []
    for m in _QUOTES.finditer(text):
        c, i = m[0], m.start()
        before = text[i - 1] if i else " "
        after = text[i + 1] if i + 1 < len(text) else " "
        if c in "\"'":
            if stack and stack[-1][0] == c and not before.isspace() and (c == '"' or not after.isalnum()):
                pairs.append((stack.pop()[1], i))
            elif (before.isspace() or before in "([—–-:") and not after.isspace():
                stack.append((c, i))
            elif c == '"' and any(o == c for o, _ in stack) and not before.isspace():
                while stack[-1][0] != c:
                    stack.pop()
                pairs.append((stack.pop()[1], i))
            continue
        if c in _CLOSERS and any(o in _CLOSERS[c] for o, _ in stack):
            while stack[-1][0] not in _CLOSERS[c]:
                stack.pop()
            pairs.append((stack.pop()[1], i))
        elif c in _PAIRS and not (c == "’" or (c == "‘" and before.isalnum())):
            stack.append((c, i))
    return pairs


def _closing(text: str, at: int, marks: str, next_char: str) -> float:
    """How well a sentence ends with the word before ``at`` and these marks."""
    if any(c in "!?؟፧;" for c in marks):
        return 3.0
    if any(c in "।॥۔።" for c in marks):
        return 3.0
    if "…" in marks or ".." in marks:
        return 0.5
    word = _TOKEN.search(text, max(0, at - 40), at)[0]
    low = word.lower().strip("*_,;:—–")
    if not low:
        return -2.0
    if low in NEVER:
        return _MISS
    digit = next_char.isdigit()
    if low in REFERENCE:
        return _MISS if digit else 0.3 if low in ("no", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec", "ave", "dept") else -3.0
    if low in ENDABLE:
        return 0.3
    if low.isdigit():
        if at - len(word) == 0 or _LIST_NUMBER.match(text[:at]):
            return _MISS
        before = text[max(0, at - len(word) - 14) : at - len(word)].split()
        return -6.0 if len(low) <= 2 and before and before[-1].lower() in BEFORE_ORDINAL and not digit else 2.5
    last = low.rpartition(".")[2].rpartition("-")[2]
    if len(last) == 1 and last.isalpha():
        if low == "h" and text[max(0, at - 3) : at - 1].strip()[-1:].isdigit():
            return 2.0
        if low in ("д", "п") and text[: at - 1].rstrip().endswith("т."):
            return 0.3
        if len(low) > 1 and low[-2] == "." and "/" in low:
            return 3.0
        if len(low) > 2 and low[-2] in ".-" and any(len(x) > 2 for x in re.split(r"[.-]", low)):
            return 3.0  # the end of a name of a file or place in the net
        return -6.0 if not digit else _MISS
    if "ऀ" <= last[-1:] <= "ॿ":
        return _MISS
    return 3.0


def _opening(text: str, at: int, after_quote: bool) -> float:
    """How well a sentence starts at ``at``."""
    c = text[at]
    if c in _OPENING:
        inner = text[at + 1 : at + 3].lstrip("\"“„«‘'¿¡(\xa0 ")[:1]
        return -6.0 if inner.islower() and c in "([（" else 1.5 if not inner.islower() else -2.0
    if after_quote:
        tag = _TAG.match(text, at)
        if tag and tag[1].lower() in SPEECH:
            return _MISS
        if _UNCASED.match(c):
            return _MISS
    if c.isupper():
        return 1.5
    if c.islower():
        return 1.0 if _CAMEL.match(text, at) else -7.0
    if c.isdigit():
        return 0.8
    if _UNCASED.match(c):
        return 0.5
    if c in "*•":
        return 0.5
    return -7.0 if c in "—–-,;:%/&=)]}»”" else 0.5


def _place(text: str, m: re.Match, pairs: list[tuple[int, int]]) -> tuple[int, float, float]:
    """(last letter, score of a span that closes here, score of a span that opens behind it) of a possible end."""
    end = m.end() - 1
    if m["thai"]:
        at = m.end()
        while text[at].isspace():
            at += 1
        return end, 3.0, -9.0 if text.startswith(("คุณ", "ๆ"), at) else 0.0
    if m["cjk"]:
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
        after = text[at] if at < len(text) else ""
        closed = [p for p in pairs if m.start() < p[1] <= end]
        if after in "，、,。：；）」』”":
            return end, 4.0, _MISS - 4
        if not closed:
            return end, 4.0, 0.0
        first = min(p[0] for p in closed)
        alone = not text[:first].strip() or text[:first].rstrip()[-1] in "。！？!?」』）)*" or _LIST_NUMBER.match(text[:first].rstrip(").、 "))
        return end, 3.0 if alone and (text[first] in "（([" or after in "「『“（") else _MISS, 0.0
    marks = m["plain"]
    at = m.end()
    while text[at].isspace():
        at += 1
    bare = marks.rstrip("\"'”’»›)]}“‘ \xa0\u202f\n\r\t")
    if len(bare) < len(marks) and marks.endswith("»") and marks[len(bare) :].strip() == "»" and marks[len(bare)].isspace() and not any(p[1] == end for p in pairs):
        return end, _MISS, 0.0  # it opens a quotation
    quoted = len(bare) < len(marks) and any(c in "\"'”’»›“‘" for c in marks[len(bare) :])
    return end, _closing(text, m.start(), bare, text[at]), _opening(text, at, quoted)


def _length(letters: int) -> float:
    return -4.0 if letters < 2 else -0.5 if letters < 4 else -SLOPE * max(0, letters - FLAT)


def best_chain(stops: list[int], closing: list[float], opening: list[float], pairs: list[tuple[int, int]]) -> list[int]:
    """Indices of the stops in the best chain of spans from the first stop to the last, both left out.

    The span from stop i to stop j scores opening[i] + closing[j] + the length's score - UNBALANCED for each pair (nested or
    apart, sorted) that has one end in it. That number is the pairs open at i, plus those open at j, less twice those open at both.
    """
    starts, back = [opening[0]], [0]  # the best chain up to a stop, with what a span that opens behind it scores there
    running: dict[tuple[int, int] | None, tuple[float, int]] = {}  # best long start overall, and of those inside each open pair
    held: list[tuple[int, int]] = []
    entered, following = 0, 0
    for j in range(1, len(stops)):
        stop = stops[j]
        while following < len(pairs) and pairs[following][0] < stop:
            held.append(pairs[following])
            following += 1
        for p in [p for p in held if p[1] <= stop]:
            held.remove(p)
            running.pop(p, None)
        while stop - stops[entered] > FLAT:
            i = entered
            start = starts[i] + SLOPE * stops[i], i
            for key in [None, *(p for p in held if p[0] < stops[i])]:
                running[key] = max(running.get(key, start), start)
            entered += 1
        top, via = -math.inf, 0
        for level, key in enumerate([None, *held]):  # who starts inside ``level`` open pairs leaves them open on both sides
            if key in running:
                value = running[key][0] + 2 * UNBALANCED * level - SLOPE * (stop - FLAT)
                if value > top:
                    top, via = value, running[key][1]
        for i in range(entered, j):
            value = starts[i]
            if stop - stops[i] < 4:
                value += _length(stop - stops[i])
            if held:
                value += 2 * UNBALANCED * sum(p[0] < stops[i] for p in held)
            if value > top:
                top, via = value, i
        starts.append(top + closing[j] + opening[j] - 2 * UNBALANCED * len(held))
        back.append(via)
    out, j = [], back[-1]
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def ends(text: str) -> list[int]:
    """The last letters of all sentences of a paragraph but the last, by the best chain of spans."""
    last = len(text) - 1
    while last >= 0 and not _LETTER.match(text[last]):
        last -= 1
    found = [m for m in _ENDS.finditer(text) if m.end() <= last]
    if not found:
        return []
    pairs = sorted(quote_pairs(text))
    places = [_place(text, m, pairs) for m in found]
    stops = [-1, *(p[0] for p in places), len(text) - 1]
    chain = best_chain(stops, [0.0, *(p[1] for p in places), 0.0], [0.0, *(p[2] for p in places), 0.0], pairs)
    return [stops[j] for j in chain]


def message_sentences(text: str | None) -> list[tuple[int, int, int]]:
    """(paragraph, start, end) of every sentence of a message; end is the last letter, in code points of the message."""
    out = []
    for number, (start, stop) in enumerate(paragraphs(text or "")):
        body, old = repaired(text[start:stop])
        begin = 0
        for end in [*ends(body), len(body) - 1]:
            while begin < end and body[begin].isspace():
                begin += 1
            first = begin if old is None else (old[begin - 1] + 1 if begin else 0)
            out.append((number, start + first, start + (end if old is None else old[end])))
            begin = end + 1
    return out


def sentences(docs: DataFrame, key: str, text: str, with_text: bool = False) -> DataFrame:
    """(key, paragraph_no, sentence_no, start_char, end_char, followed, sentence): every sentence of every message.

    end_char is the 0-based place of the sentence's last letter; followed says that another one follows in its
    paragraph; sentence is null unless ``with_text``. A null or empty text has no sentences. Keys need not be unique; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            for i, cell in enumerate(batch.column(1)):
                whole = cell.as_py()
                found = message_sentences(whole)
                for n, (p, a, b) in enumerate(found):
                    index.append(i)
                    rows.append((p, n, a, b, n + 1 < len(found) and found[n + 1][0] == p, whole[a : b + 1] if with_text else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["key", "paragraph_no", "sentence_no", "start_char", "end_char", "followed", "sentence"]
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, paragraph_no int, sentence_no int, start_char bigint, end_char bigint, followed boolean, sentence string").withColumnRenamed("key", key)
