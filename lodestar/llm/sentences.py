"""Sentence units across languages and scripts, as offsets in code points.

A pushdown automaton reads a text by its events only (terminators, quotation marks, brackets, line ends, spaces
in scripts that separate sentences by them): its stack holds the open quotations and brackets, inside
which nothing ends a unit; lists and headings are line states. Abbreviations are looked up in a trie of
reversed words; each class says after what it still ends a sentence. Script, not a language label, decides
which terminators count, so wrong or missing labels do no harm.

Defined results: units cover all text but white space and carry none outside; a blank line, a list item's
line and a heading before a list end a unit; an opening mark that is never closed in its paragraph is
taken as plain text; null, empty and blank texts give no units; one enormous text is one row's work and
its units are emitted as rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Never the end of a unit (titles, and words that something always follows).
TITLES = (
    "dr mr mrs ms mx prof st mt sr hon rev gen col capt lt sgt messrs mme mlle mm m pr me hr fr frl dipl ing dra sra srta dña d avda av ud uds vd vds "
    "e.g i.e cf vs approx ca bzw vgl z u d h zzgl inkl exkl evtl ggf sog env ex ej p.ex p.ej z.b d.h u.a v.a i.d.r o.ä s.o s.u est ee डॉ श्री أ د م dept bldg"
).split()
#: The end of a unit unless a figure follows.
NUMERIC = "no nos nr nrn núm num fig figs abb bd vol vols pp p pág págs pag pags art arts sec sect ch kap ziff abs tel ext apt ste रु सं ص n".split()
#: The end of a unit if a capital, a mark or another script follows.
ENDABLE = "etc usw inc ltd corp co llc plc bros u.s u.k u.n e.u a.m p.m ph.d m.d b.a m.a b.sc m.sc d.c jr uu ee.uu s.a s.l u.s.a cía cia esq al st.".split()
#: Names that begin sentences in lower case.
LOWER_STARTS = set("npm pip dbt git kubectl macos".split())
#: Words after which a figure with a period is an ordinal (German), i.e. what such an ordinal counts.
ORDINAL_NOUNS = set(
    "januar februar märz april mai juni juli august september oktober november dezember jänner quartal halbjahr jahrhundert jahrestag jahr stock stockwerk etage klasse platz auflage semester woche tag kapitel".split()
)
#: Articles: an abbreviation right after one that opens the unit belongs to what follows ("The U.S. Desk").
ARTICLES = set("the a an this that these those our your their its his her der die das le la les el los las un una".split())

STOPS = ".!?…。！？｡؟।॥۔"
ALWAYS = set("。！？｡।॥؟۔")
OPENERS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉", "{": "}"}
CLOSERS = set("”“»›」』)]）】》〉}")
QUOTES = set("“„«‹「『\"”»›」』")
BRACKETS = set("()[]（）【】{}")
EVENTS = re.compile(r'[.!?…。！？｡؟।॥۔“”„«»‹›「」『』()\[\]（）【】《》〈〉{}"]|[฀-๿]\s+(?=\S)')
MARKS = re.compile(r'[“”„«»‹›「」『』()\[\]（）【】《》〈〉{}"]')
TOKEN_MARKS = re.compile(r"\s|@|://")
LIST_MARK = re.compile(r"[ \t]*(?:[*•‣◦▪●○·・–—\-]|\(?\d{1,3}\)|\(?[a-zA-Z]\)|\d{1,3}\.)(?=\s)")
PLAIN_NUMBER = re.compile(r"[ \t]*(\d{1,3})\.(?=\s)")


class Trie:
    """Reversed-word trie: the longest abbreviation that ends a text, and its class."""

    def __init__(self, classes: dict[str, list[str]]):
        self.root: dict = {}
        for name, words in classes.items():
            for w in words:
                node = self.root
                for c in reversed(w):
                    node = node.setdefault(c, {})
                node[""] = name

    def find(self, text: str, end: int) -> str | None:
        """Class of the longest abbreviation ending at ``end`` on a word boundary."""
        node, best, i = self.root, None, end
        while i > 0 and (node := node.get(text[i - 1].lower())) is not None:
            i -= 1
            if "" in node and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] in ".@_") or self._after_joined_stop(text, i)):
                best = node[""]
        return best


    @staticmethod
    def _after_joined_stop(text: str, i: int) -> bool:
        """Whether a capital at ``i`` follows a sentence's period without a space ("newcomer.Fig. 3")."""
        return i > 1 and text[i - 1] == "." and text[i].isupper() and (text[i - 2].islower() or text[i - 2].isdigit())


ABBREVIATIONS = Trie({"title": TITLES, "numeric": NUMERIC, "endable": ENDABLE})


def lines_of(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in re.finditer("\\r\\n|[\\n\\r\\v\\f\\x85\\u2028\\u2029]", text):
        out.append((at, m.start()))
        at = m.end()
    return out + [(at, len(text))]


def blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, end of list mark) of the spans that units never cross: paragraphs, list items, headings before lists."""
    out: list[list[int]] = []
    listing, last_number = False, 0
    fresh = True  # a new block begins at the next line
    for a, b in lines_of(text):
        line = text[a:b]
        if not line.strip():
            fresh, listing, last_number = True, False, 0
            continue
        m = LIST_MARK.match(line)
        if m and (plain := PLAIN_NUMBER.match(line)):
            n = int(plain.group(1))
            # "9." opening a wrapped line is no list mark; "1." or the number after the item before is
            if not (fresh or listing and n == last_number + 1 or n == 1 and not listing):
                m = None
            elif not fresh and n != 1 and not listing:
                m = None
            last_number = n if m else last_number
        if m and m.end() < len(line) and line[m.end() :].strip():
            out.append([a, b, a + m.end()])
            listing, fresh = True, True
            continue
        if fresh or listing:
            out.append([a, b, a])
        else:
            out[-1][1] = b
        fresh, listing = False, False
    return [(a, b, c) for a, b, c in out]


def is_upper_start(text: str, i: int, end: int) -> bool | None:
    """Whether what follows begins a sentence by its case; None for scripts without case and for marks."""
    if i >= end:
        return None
    c = text[i]
    if c.isupper() or c.istitle():
        return True
    if c.islower():
        m = re.match(r"[^\W\d_]+", text[i : i + 24])
        w = m.group() if m else c
        return w.lower() in LOWER_STARTS or any(x.isupper() for x in w[1:])
    return None


def latin(c: str) -> bool:
    return c.isalpha() and ord(c) < 0x250


class Reader:
    """Emits the unit ends of one block."""

    def __init__(self, text: str):
        self.text = text
        self._read = self._token = 0
        self._mail = -1

    def token_start(self, i: int, start: int) -> int:
        """Where the run without white space that ends at ``i`` begins, not before ``start``; reads on from the last call."""
        for m in TOKEN_MARKS.finditer(self.text, min(self._read, i), i):
            if m.group().isspace():
                self._token = m.end()
            else:
                self._mail = m.start()
        self._read = max(self._read, i)
        return max(self._token, start)

    def matched(self, start: int, end: int) -> dict[int, int]:
        """Closing position of each quotation mark or bracket opened and closed within [start, end)."""
        t, stack, out = self.text, [], {}
        for m in MARKS.finditer(t, start, end):
            i = m.start()
            c = t[i]
            if stack and c in stack[-1][0]:
                out[stack.pop()[1]] = i
            elif c == '"':
                stack.append(('"', i))
            elif c in OPENERS:
                stack.append((OPENERS[c], i))
        return out

    def period_ends(self, i: int, j: int, end: int, start: int) -> bool:
        """Whether the period at ``i`` ends a unit; ``j`` is where the next character other than space stands."""
        t = self.text
        before = t[i - 1] if i > start else ""
        after = t[i + 1] if i + 1 < end else ""
        if after and not after.isspace() and after not in CLOSERS and after not in '"':
            # no space follows: decimals, names with periods, addresses; but "plan ahead.Candidates" ends
            if not (after.isalpha() or after in OPENERS or after in "¿¡"):
                return False
            if after.isalpha() and after.islower():
                return False
            k = self.token_start(i, start)
            if self._mail >= k or t[k : k + 3].lower() == "www":
                return False
            if latin(after):
                w = i
                while w > k and t[w - 1].isalpha():
                    w -= 1
                nxt = t[i + 2] if i + 2 < end else ""
                word, token = t[w:i], t[i - 1] if i > k else ""
                if ABBREVIATIONS.find(t, i) == "title" and len(word) > 1:
                    return False
                if len(word) < 2 and not (token and token[-1].isdigit()) or nxt == "." and len(word) < 3 or word.lower() == "ph":
                    return False
        kind = ABBREVIATIONS.find(t, i)
        word = ""
        k = i
        while k > start and (t[k - 1].isalnum()):
            k -= 1
        word = t[k:i]
        nxt = t[j] if j < end else ""
        if not nxt:
            return True
        if kind == "title":
            return False
        if kind == "numeric":
            return not nxt.isdigit() and is_upper_start(t, j, end) is not False
        if kind == "endable":
            up = is_upper_start(t, j, end)
            if up is False:
                return False
            if up is None and nxt in ",;:)":
                return False
            head = t[start:i].split()
            return not (len(head) == 2 and head[0].lower() in ARTICLES)
        if len(word) == 1 and word.isalpha() and word.isupper() and latin(word):
            return False  # an initial
        if len(word) == 1 and word.isalpha() and latin(word) and (nxt.islower() or nxt.isdigit()):
            return False  # "u. a. 9"
        if word.isdigit() and len(word) <= 2:
            m = re.match(r"[^\W\d_]+", t[j : j + 24])
            if m and m.group().lower() in ORDINAL_NOUNS:
                return False
        return nxt not in ",;:"

    def ends(self, start: int, end: int) -> list[int]:
        """Unit ends within [start, end); marks without their counterpart are ordinary characters."""
        t, out, stack, match = self.text, [], [], self.matched(start, end)
        unit = start
        skip = start
        for m in EVENTS.finditer(t, start, end):
            i = m.start()
            if i < skip:
                continue
            c = t[i]
            if len(m.group()) > 1 or "฀" <= c <= "๿":
                # a space after Thai text: a figure or a foreign word it sets off is no new unit
                j = m.end()
                if not stack and j < end and ("฀" <= t[j] <= "๿" or t[j] in OPENERS):
                    out.append(i + 1)
                    unit = j
                continue
            if c in QUOTES or c in BRACKETS or c in OPENERS or c in CLOSERS:
                if stack and match[stack[-1]] == i:
                    opener = stack.pop()
                    if not stack:
                        k = i + 1
                        inner = i - 1
                        while inner > opener and t[inner].isspace():
                            inner -= 1
                        if t[inner] in STOPS and self.closes(opener, inner, k, end, unit, c):
                            while k < end and t[k] in CLOSERS:
                                k += 1
                            out.append(k)
                            unit = self.next_text(k, end)
                            skip = k
                elif i in match:
                    stack.append(i)
                continue
            if stack:
                continue
            # a run of terminators counts as one
            k = i + 1
            while k < end and t[k] in STOPS:
                k += 1
            run = t[i:k]
            skip = k
            j = self.next_text(k, end)
            if run == ".":
                if not self.period_ends(i, j, end, unit):
                    continue
            elif set(run) <= {".", "…"}:
                if j < end:
                    up = is_upper_start(t, j, end)
                    if up is False or up is None and t[j] not in OPENERS and t[j] not in '"¿¡' and not (t[j].isdigit() and j > k) and not (j > k and latin(t[max(unit, i - 1)])):
                        continue
            elif not set(run) & ALWAYS:
                nxt = t[k] if k < end else ""
                if nxt and not nxt.isspace() and nxt not in CLOSERS and nxt not in '"' and not (nxt.isalpha() and not nxt.islower() or nxt in OPENERS or nxt in "¿¡"):
                    continue
                if j < end and t[j] in ",;":
                    continue
            while k < end and t[k] in CLOSERS and t[k] not in OPENERS:
                k += 1
            out.append(k)
            unit = self.next_text(k, end)
            skip = k
        out.append(end)
        return out

    def next_text(self, k: int, end: int) -> int:
        while k < end and self.text[k].isspace():
            k += 1
        return k

    def closes(self, opener: int, inner: int, k: int, end: int, unit: int, closer: str) -> bool:
        """Whether a unit ends behind a quotation or bracket whose content ended with a terminator."""
        t = self.text
        j = self.next_text(k, end)
        if j >= end:
            return True
        if t[j] in STOPS or t[j] in ",;:、，；：،؛":
            return False
        up = is_upper_start(t, j, end)
        if closer in BRACKETS:
            return up is not False or self.next_text(unit, end) == opener
        if up is False:
            return False  # an attribution goes on
        if up is True:
            # a capitalised name after a quotation in a script without case is its attribution
            return any(latin(x) for x in t[opener + 1 : inner])
        if t[j] in OPENERS or t[j] == '"' or t[j] in "¿¡":
            return True
        return any(latin(x) for x in t[opener + 1 : inner]) and not t[j].isalpha() or any(latin(x) for x in t[opener + 1 : inner]) and not latin(t[j])


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the units of one text, in code points, without outer white space."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    reader = Reader(text)
    for a, b, mark in blocks(text):
        at = a
        for e in reader.ends(mark, b):
            s, x = at, e
            while s < x and text[s].isspace():
                s += 1
            while x > s and text[x - 1].isspace():
                x -= 1
            if x > s:
                out.append((s, x))
            at = e
    return out


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_start, sent_end) of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, starts, ends = [], [], []
            for d, t in zip(b["k"], b["t"]):
                for s, e in sentence_spans(t):
                    ids.append(d)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({key: ids, "sent_start": starts, "sent_end": ends}).astype({"sent_start": "int64", "sent_end": "int64"})

    src = docs.select(docs[key].alias("k"), docs[text].alias("t")).where("k is not null and t is not null")
    return src.mapInPandas(run, f"{key} {docs.schema[key].dataType.simpleString()}, sent_start bigint, sent_end bigint")
