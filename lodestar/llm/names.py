"""Parts of a typed organisation name and of its short token: founder, family words, trade, legal form."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

#: Legal forms, as typed. Fixed values.
LEGAL = set("inc incorporated llc ltd limited co company corp corporation group grp plc gmbh ag sa sarl bv nv lp llp pllc pty kg oy ab srl spa holdings holding".split())
#: Trades and how they are shortened. Fixed values.
TRADES = {
    "associates": "assoc assocs associate", "communications": "comms comm communication commns", "construction": "constr constrn const", "education": "edu educ", "energy": "nrg enrgy energ", "financial": "fin finl fincl finance", "foods": "fds food fd",
    "health": "hlth healthcare", "insurance": "ins insur insce", "laboratories": "labs lab laboratory", "logistics": "log logs logist logis", "management": "mgmt mgt mngmt managemt", "manufacturing": "mfg manuf mfrg manufg", "robotics": "robo robot robots robotic",
    "services": "svcs svc service serv servs", "technologies": "tech techs technology technol", "systems": "sys system syst", "partners": "ptnrs partner", "consulting": "consult consultg", "media": "", "software": "sw softw", "solutions": "soln solns", "industries": "ind inds indus", "analytics": "anlytcs", "capital": "cap", "design": "dsgn", "transport": "transp trans", "engineering": "eng engg engr",
}
#: Given names and their short forms. Fixed values.
GIVEN = {
    "alexander": "alex sasha xander", "charles": "chuck charlie chas", "elizabeth": "liz beth betty eliza lizzie", "jennifer": "jen jenny jenn", "katherine": "kate kathy katie kat cathy kathryn catherine", "margaret": "maggie meg peggy peg marge", "michael": "mike mick mikey",
    "patricia": "pat patty trish tricia patti", "richard": "rick dick rich ricky richie", "robert": "bob rob bobby robbie bert", "theodore": "ted theo teddy", "william": "bill will billy liam willy", "james": "jim jimmy jamie", "john": "jack johnny", "joseph": "joe joey", "thomas": "tom tommy", "david": "dave", "daniel": "dan danny",
    "christopher": "chris", "matthew": "matt", "anthony": "tony", "steven": "steve", "edward": "ed eddie ned", "susan": "sue susie", "barbara": "barb", "deborah": "deb debbie", "nicholas": "nick", "samuel": "sam", "benjamin": "ben", "rebecca": "becky", "victoria": "vicky", "andrew": "andy drew", "gregory": "greg", "lawrence": "larry", "frederick": "fred",
}
#: Contractions of given names that are no beginnings of them. Fixed values.
WRITTEN = {"wm": "william", "chas": "charles", "robt": "robert", "thos": "thomas", "jas": "james", "jos": "joseph", "geo": "george", "richd": "richard", "margt": "margaret", "benj": "benjamin"}
#: Words that boards and typists hang on tokens.
TOKEN_TAILS = ("careers", "career", "jobs", "job", "hiring", "us", "usa", "hq", "inc", "llc", "ltd", "corp", "co", "group", "grp", "limited", "company", "corporation", "incorporated")

TRADE_OF = {w: t for t, ws in TRADES.items() for w in (t, *ws.split())}
GIVEN_OF = {w: g for g, ws in GIVEN.items() for w in (g, *ws.split())}


def fold(text: str) -> str:
    """Lower case without accents."""
    t = unicodedata.normalize("NFKD", text)
    return "".join(c for c in t if not unicodedata.combining(c)).lower()


@dataclass(frozen=True)
class Name:
    """Parts of a name: ``family`` words in typed order; ``initials`` where the name is letters only."""

    founder: str | None
    founder_initial: str | None
    family: tuple[str, ...]
    trade: str | None
    legal: str | None
    initials: str | None


def legal_of(w: str) -> str | None:
    same = {"incorporated": "inc", "limited": "ltd", "company": "co", "corporation": "corp", "grp": "group"}
    return same.get(w, w) if w in LEGAL else None


def parse_name(raw: str | None) -> Name:
    """Parts of a typed name; all empty for null or symbol-only names."""
    text = re.sub(r"\bd\s*/?\s*b\s*/?\s*a\b.*$", "", raw or "", flags=re.I | re.S)
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z]+(?:\b|[a-z]))", " ", unicodedata.normalize("NFC", text))
    text = fold(text).replace("fin'l", "finl").replace("'", "")
    text = re.sub(r"\bl\.\s?l\.\s?c\b\.?", "llc", text)
    words = re.findall(r"[^\W_]+", text)
    if words[:1] == ["the"]:
        words = words[1:]
    legal = None
    while len(words) > 1 and legal_of(words[-1]):
        legal = legal or legal_of(words[-1])
        words = words[:-1]
    trade, rest = None, []
    for i, w in enumerate(words):
        if trade is None and w in TRADE_OF and (len(words) > 1):
            trade = TRADE_OF[w]
        else:
            rest.append(w)
    if rest and all(len(w) == 1 for w in rest) or len(rest) == 1 and len(rest[0]) <= 3 and rest[0].isalpha() and rest[0].isascii():
        return Name(None, None, (), trade, legal, "".join(rest))
    founder = initial = None
    if len(rest) > 2 and (lone := [w for w in rest if len(w) == 1]):
        initial = lone[0]
        rest = [w for w in rest if len(w) > 1]
    given = next((i for i, w in enumerate(rest) if w in GIVEN_OF), 0) if len(rest) > 2 else 0
    rest = rest[given : given + 1] + rest[:given] + rest[given + 1 :]  # "Dufutu Rorpranchel, Theodore"
    if len(rest) > 1 and rest[0] in GIVEN_OF:
        founder, rest = GIVEN_OF[rest[0]], rest[1:]
    elif len(rest) > 1 and len(rest[0]) == 1:
        initial, rest = rest[0], rest[1:]
    else:  # a given name typed with an error, in front of two family words
        if len(rest) > 2 and (g := near_given(rest[0])):
            founder, rest = g, rest[1:]
    rest = [w for w in rest if w != "and"]
    if trade is None and len(rest) > 2:  # a trade shortened or typed in a way of its own
        for i in range(len(rest) - 1, -1, -1):
            if (t := near_trade(rest[i])) is not None:
                trade, rest = t, rest[:i] + rest[i + 1 :]
                break
    return Name(founder, initial, tuple(rest), trade, legal, None)


def near_trade(w: str) -> str | None:
    """The one trade a word shortens (its letters in order, the first one kept) or misspells by one edit."""
    if len(w) < 3:
        return None
    close = [t for t in TRADES if t[0] == w[0] and (subsequence(w, t) and len(w) < len(t) or len(w) > 4 and one_edit(w, t))]
    return close[0] if len(close) == 1 else None


def subsequence(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


def near_given(w: str) -> str | None:
    """The given name a word begins, or a longer word is within one edit of."""
    if w in WRITTEN:
        return WRITTEN[w]
    whole = [g for g in GIVEN if len(w) >= 3 and g.startswith(w)]
    if len(whole) == 1:
        return whole[0]
    if len(w) < 6:
        return None
    for g in GIVEN:
        if g[0] == w[0] and abs(len(g) - len(w)) <= 1 and one_edit(w, g):
            return g
    return None


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by at most one insertion, deletion, replacement or neighbour swap."""
    if a == b:
        return True
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i + 1 : i + 2] == b[i : i + 1] and a[i : i + 1] == b[i + 1 : i + 2] and a[i + 2 :] == b[i + 2 :])


@dataclass(frozen=True)
class Token:
    """Parts of a token: ``squashed`` without separators and tails; ``family`` what is left of it."""

    squashed: str
    founder: str | None
    family: str
    trade: str | None


def parse_token(raw: str | None) -> Token | None:
    """Parts of a typed short token, or None where there is none."""
    s = re.sub(r"[^a-z0-9]+", "-", fold(raw or "")).strip("-")
    if not s:
        return None
    parts = [p for p in s.split("-") if p]
    flat = re.sub(r"\d+$", "", "".join(parts))
    changed = True
    flat = re.sub(r"dba.*$", "", flat) if "dba" in flat[8:] else flat
    while changed:
        changed = False
        for tail in TOKEN_TAILS:
            if flat.endswith(tail) and len(flat) - len(tail) >= 8:
                flat, changed = flat[: -len(tail)], True
                break
    squashed, founder, trade = flat, None, None
    if flat.startswith("the") and len(flat) > 12 and not flat.startswith("theo"):
        flat = flat[3:]
    words = [p for p in parts if p not in TOKEN_TAILS and p != "the"]
    if len(words) > 2 and words[-1] in TRADE_OF and flat.endswith(words[-1]):
        trade, flat = TRADE_OF[words[-1]], flat[: -len(words[-1])]
    elif len(words) > 2 and words[0] in TRADE_OF and flat.startswith(words[0]):
        trade, flat = TRADE_OF[words[0]], flat[len(words[0]) :]
    else:
        trade, flat = cut_trade(flat)
    if len(words) > 2 and words[0] in GIVEN_OF and flat.startswith(words[0]):
        founder, flat = GIVEN_OF[words[0]], flat[len(words[0]) :]
    else:
        for w in GIVEN:
            if len(w) > 5 and flat.startswith(w) and len(flat) - len(w) >= 8:
                founder, flat = w, flat[len(w) :]
                break
    return Token(squashed, founder, flat, trade)


def cut_trade(flat: str) -> tuple[str | None, str]:
    """(trade, rest) of a token without separators; words of under four letters are too easily part of a family name."""
    for w in sorted((w for w in TRADE_OF if len(w) > 3), key=lambda w: (-len(w), w)):
        if flat.endswith(w) and len(flat) - len(w) >= 5:
            return TRADE_OF[w], flat[: -len(w)]
        if flat.startswith(w) and len(flat) - len(w) >= 8:
            return TRADE_OF[w], flat[len(w) :]
    for t in TRADES:
        for n in (len(t), len(t) - 1, len(t) + 1):
            if len(t) > 5 and len(flat) - n >= 8 and one_edit(flat[-n:], t):
                return t, flat[:-n]
    return None, flat
