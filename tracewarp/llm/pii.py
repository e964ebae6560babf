"""Personal data and secrets by a skip-chain conditional random field.

A text is cut at white space. Its chain of tokens has potentials for each token's features, for those of its neighbours
and for the labels of neighbours; skip edges join a token to its previous occurrence in the document, and to the previous
token similar to it (the same domain, or the same shape and beginning), however far away, and reward equal labels.
Loopy belief propagation passes messages over chain and skip edges of a document until they settle.

Features say what a token is made of (its shape, characters, lengths, beginnings and ends, check digits) and what stands
around it. No feature is a label's pattern: labels come only from examples that are made up entity by entity, in
sentences of words of the corpus, so a name is found by a title before it, and found again, by a skip edge, where it
stands without one.

A token is passed over where, by a bound that holds whatever its neighbours are, its odds against being an entity are
more than exp(``GATE``) to one; it then counts as O, and its neighbours see it as that. All other tokens are nodes, and
the nodes of many documents are passed at once as one graph of separate parts, each until it settles by itself.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarp.llm.common import map_arrow, quoted, text_chunks

LABELS = ("O", "EMAIL", "PHONE", "CARD", "IP", "SECRET", "NAME", "ID", "ADDRESS")
O, EMAIL, PHONE, CARD, IP, SECRET, NAME, ID, ADDRESS = range(len(LABELS))
K = len(LABELS)
#: Labels of which a run of neighbours is one entity.
RUNS = {PHONE, CARD, NAME, ID, ADDRESS}
#: Most documents whose words are the examples' background: those with the smallest hashes of their ids.
MAX_TRAINING_DOCUMENTS = 500
EXAMPLES = 1500
STEPS, RATE, DECAY = 120, 0.15, 5e-4
#: Bounds of the learnt rewards for equal labels along skip edges.
MOST_SKIP = 2.5
ROUNDS, DAMPING, SETTLED = 30, 0.3, 1e-4
GATE, THRESHOLD = 7.0, 0.75
#: Distinct tokens whose scores a worker remembers.
REMEMBERED = 300_000
SCHEMA = "doc_id long, start int, end int, label string, score double"

EDGE = ".,;:!?*$%&#|<>[]{}\"'`"
TOKEN = re.compile(r"\S+")
DIGITS = re.compile(r"\d+")
NUMBER = re.compile(r"[+(]*\d[\d()-]*")


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def shape(s: str) -> str:
    """Runs of digits, small and capital letters by one character each."""
    return re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d+", "9", s)))


def lengths(s: str) -> str:
    """The shape with the lengths of runs of digits; those of letters only as 1, 2 or more."""
    s = re.sub(r"[A-Z]+", lambda m: "A" if len(m[0]) == 1 else "AA", re.sub(r"[^\W\d_A-Z]+", lambda m: "a" if len(m[0]) == 1 else "aa", s))
    return re.sub(r"\d+", lambda m: f"<{len(m[0])}>", s)


def similarity(bare: str) -> str:
    """Tokens of one such value are similar."""
    return bare.rpartition("@")[2].lower() if "@" in bare else f"{shape(bare)} {bare[:4].lower()}"


def features(tok: str) -> tuple[list[str], list[str]]:
    """What a token is made of, and what its neighbours see of it."""
    bare = tok.strip(EDGE)
    low = bare.lower()
    if bare.isalpha():
        kind = "Aa" if bare[0].isupper() and bare[1:].islower() else "AA" if bare.isupper() and len(bare) > 1 else "A" if bare.isupper() else "a" if bare.islower() else "mixed"
        end = "." if tok[-1:] in ".,;:!?" else ""
        seen = ["k=" + kind, "w=" + low, f"k={kind}{end}"]
        out = [*seen, f"e={low[-3:]}"]
        if kind == "mixed" or len(bare) > 14:
            out.append(f"long={len(bare) // 8}")
        return out, seen
    s, n = shape(bare), len(bare)
    digits = sum(c.isdigit() for c in bare)
    letters = sum(c.isalpha() for c in bare)
    parts = DIGITS.findall(bare)
    seen = ["s=" + s, f"d={digits}"]
    out = [
        "s=" + s, "l=" + lengths(bare), f"n={min(n // 4, 12)}", f"d={min(digits, 24)}", f"c={min(letters // 4, 8)}", f"p={low[:3]}", f"e={low[-3:]}",
        *(f"has{c}{min(bare.count(c), 4)}" for c in "@.:-=/_+()" if c in bare),
    ]
    if digits and letters:
        turns = len(s)
        out += [f"turns={min(turns // 3, 8)}", f"hex={all(c in '0123456789abcdefABCDEF' for c in bare)} {min(n // 8, 8)}", f"case={bare.isupper()}{bare.islower()}"]
    if letters > 12 and bare.isupper():
        out.append(f"caps={min(n // 4, 8)}")
    if len(parts) > 2:
        out.append(f"octets={all(len(p) < 4 and int(p) < 256 for p in parts)} {min(len(parts), 6)}")
    if not letters and 13 <= digits <= 19:
        out.append(f"check={luhn(''.join(parts))} {digits}")
    if ":" in bare:
        out.append(f"colons={min(bare.count(':'), 8)} hex={all(c in '0123456789abcdefABCDEF:.' for c in bare)}")
    head, eq, tail = bare.partition("=")
    if eq and head and tail:
        out += [f"key={head.lower()}", f"keyed={min(len(tail) // 3, 6)}"]
        seen.append(f"key={head.lower()}")
    return out, seen


@dataclass
class Tokens:
    """Tokens of many documents in order: the number of the distinct token, of the document, and of each distinct token what it has."""

    kind: np.ndarray
    document: np.ndarray
    distinct: list[str]

    @classmethod
    def of(cls, texts: list[str | None]) -> Tokens:
        index: dict[str, int] = {}
        kinds: list[int] = []
        n = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                got = [index.setdefault(w, len(index)) for w in t.split()]
                kinds.extend(got)
                n[i] = len(got)
        return cls(np.array(kinds, np.int64), np.repeat(np.arange(len(texts)), n), list(index))

    def joined(self) -> np.ndarray:
        """Whether each token but the last has its successor in its document."""
        return self.document[1:] == self.document[:-1]

    def runs(self) -> tuple[np.ndarray, list[str]]:
        """(tokens, features): the first of each document, and of groups of digits that stand together what they are as one number."""
        plain = np.array([not d.isalpha() and NUMBER.fullmatch(d.strip(EDGE)) is not None for d in self.distinct], bool)
        if not len(self.kind):
            return np.zeros(0, np.int64), []
        is_ = plain[self.kind]
        start = is_ & ~np.concatenate([[False], is_[:-1] & self.joined()])
        at = np.flatnonzero(np.concatenate([[True], ~self.joined()])).tolist()
        out = ["first"] * len(at)
        number = np.cumsum(start) * is_
        tokens = np.flatnonzero(is_)
        order = number[tokens]
        for members in np.split(tokens, np.flatnonzero(np.diff(order)) + 1):
            if len(members) > 1:
                all_ = "".join("".join(c for c in self.distinct[self.kind[i]] if c.isdigit()) for i in members)
                f = f"run={min(len(members), 6)} {min(len(all_), 24)} {13 <= len(all_) <= 19 and luhn(all_)}"
                at.extend(members.tolist())
                out.extend([f] * len(members))
        return np.array(at, np.int64), out

    def keys(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers of each node's token: equal tokens share the first, similar ones the second."""
        some, at = np.unique(self.kind[nodes], return_inverse=True)
        bare = [self.distinct[k].strip(EDGE) for k in some]
        out = []
        for of in (str.lower, similarity):
            names: dict[str, int] = {}
            out.append(np.array([names.setdefault(of(b), len(names)) for b in bare], np.int64)[at])
        return out[0], out[1]

    def edges(self, nodes: np.ndarray) -> np.ndarray:
        """(from, to, kind) between numbers of nodes: 0 neighbours, 1 the previous equal one, 2 the previous similar one if it is another."""
        if not len(nodes):
            return np.zeros((0, 3), np.int64)
        doc = self.document[nodes]
        near = np.flatnonzero((np.diff(nodes) == 1) & (np.diff(doc) == 0))
        out = [np.stack([near, near + 1, np.zeros_like(near)], axis=1)]
        before = np.full(len(nodes), -1)
        for k, key in enumerate(self.keys(nodes), 1):
            order = np.lexsort((nodes, key, doc))
            a, b = order[:-1], order[1:]
            same = (doc[a] == doc[b]) & (key[a] == key[b])
            same[same] = nodes[b[same]] - nodes[a[same]] > 1  # neighbours have their edge
            a, b = a[same], b[same]
            if k == 1:
                before[b] = a
            else:
                a, b = a[before[b] != a], b[before[b] != a]
            out.append(np.stack([a, b, np.full(len(a), k)], axis=1))
        return np.concatenate(out)


@dataclass
class Example:
    tokens: list[str] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)

    def add(self, text: str, label: int | list[int] = O) -> None:
        parts = text.split()
        self.tokens += parts
        self.labels += label if isinstance(label, list) else [label] * len(parts)


_SYLLABLES = "an ber co da el fin gar ho ix jo kel lu mar no or pa quin ros sa tor ul ven wil xa yo zan".split()
_TITLES = "Mr. Mrs. Ms. Dr. Prof. Herr Frau Señor Señora Madame Monsieur Dear".split()
_STREETS = "Street St Road Rd Avenue Ave Lane Drive Boulevard Square".split()


def examples(words: list[str], n: int = EXAMPLES, seed: int = 5) -> list[Example]:
    """Made-up documents of every label, and of what is like them but harmless, in sentences of the given words."""
    r = random.Random(seed)
    pick = r.choice
    words = words or ["word", "The", "other", "of", "and", "That", "is", "A"]
    firsts = [i for i, w in enumerate(words) if w[:1].isupper()] or [0]
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    syllables = lambda a, b: "".join(pick(_SYLLABLES) for _ in range(r.randint(a, b)))
    name = lambda: syllables(2, 3).capitalize()
    chars = lambda k, of: "".join(pick(of) for _ in range(k))
    hexes, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def number(k: int, good: bool) -> str:
        d = pick("3456") + digits(k - 2)
        return next(d + c for c in "0123456789" if luhn(d + c) == good)

    def grouped(d: str) -> str:
        parts = [d[:4], d[4:10], d[10:]] if len(d) == 15 else [d[i : i + 4] for i in range(0, len(d), 4)]
        return pick([" ", " ", "-"]).join(parts)

    def email() -> str:
        user = pick([syllables(1, 3), f"{syllables(1, 2)}.{syllables(1, 2)}", f"{syllables(1, 2)}.{digits(2)}", f"{pick(words).strip(EDGE).lower()}.{digits(2)}", f"{syllables(1, 2)}{digits(3)}", f"{syllables(1, 2)}_{syllables(1, 2)}+{syllables(1, 1)}"])
        host = pick([syllables(2, 3), f"mail{digits(1)}.{syllables(1, 3)}", f"{syllables(1, 2)}-{syllables(1, 2)}", f"mail{digits(1)}.example"])
        return f"{user}@{host}.{pick(['com', 'org', 'net', 'de', 'fr', 'co.uk', 'es', 'io'])}"

    def phone() -> str:
        return pick([
            f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{pick('23456789')}{digits(2)}-{digits(3)}-{digits(4)}",
            f"+{r.randint(20, 99)} {digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)}-{digits(7)}", f"+{r.randint(10, 99)}{digits(10)}", f"{digits(3)}.{digits(3)}.{digits(4)}",
        ])

    def secret() -> tuple[str, list[int]]:
        h = chars(pick([32, 40, 40, 40, 64]), hexes)
        h = h.upper() if r.random() < 0.2 else h
        key = pick(["token", "secret", "api_key", "key", "password", "Token"])
        made = pick([f'{key} = "{h}"', f'{key} = "{h}"', f"{key}: {h}", f"{pick(['password', 'passwd', 'pwd', 'secret', 'token', 'api_key'])}={chars(r.randint(6, 24), mixed)}", f"{pick(['password', 'pwd', 'secret'])}={syllables(1, 3)}{digits(r.randint(3, 6))}",
                     pick(["AKIA", "ASIA"]) + chars(16, upper), "ghp_" + chars(36, mixed), "sk-" + chars(pick([32, 48]), mixed)])
        parts = made.split()
        return made, [O] * (len(parts) - 1) + [SECRET]

    def ident() -> tuple[str, list[int]]:
        doc = pick(["passport", "licence", "ID", "Passport"])
        made = pick([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"{chars(2, 'DEFRGBITNL')}{digits(2)}{digits(18)}", f"{chars(2, 'DEFRGBITNL')}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", f"{doc} {chars(2, upper[:26])}{digits(7)}"])
        parts = made.split()
        return made, [O] + [ID] * (len(parts) - 1) if parts[0] == doc else [ID] * len(parts)

    def address() -> tuple[str, list[int]]:
        made = pick([f"{r.randint(1, 999)}{pick(['', '', 'B'])} {name()} {pick(_STREETS)}", f"{name()}{pick(['straße', 'strasse', 'weg', 'gasse'])} {r.randint(1, 99)}", f"{r.randint(1, 99)} rue {name()}", f"calle {name()} {r.randint(1, 99)}"])
        return made, [ADDRESS] * len(made.split())

    def harmless() -> str:
        return pick([
            f"{r.randint(0, 9)}.{r.randint(0, 20)}", f"{r.randint(0, 9)}.0", f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"20{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"{r.randint(0, 23)}:{digits(2)}", f"${digits(2)}.{digits(2)}", digits(r.randint(1, 8)), digits(r.randint(1, 4)),
            f"x={r.randint(0, 99)}", "=", f"@{syllables(1, 2)}", f"{syllables(1, 2)}{digits(2)}", f"({digits(4)})", f"{digits(3)}-{digits(2)}", ".".join(str(r.randint(256, 999)) for _ in range(4)), chars(r.randint(10, 24), upper[:26]), f"{digits(4)} {digits(4)}", f"{r.randint(1, 99)}%", f"1,{digits(3)}",
            number(16, False), number(16, False), grouped(number(16, False)), f"commit {chars(40, hexes)}", f"{name()}-{digits(2)}", f"{pick(['chapter', 'Chapter', 'version', 'Version', 'section', 'page', 'Table'])} {pick([str(r.randint(1, 40)), f'{r.randint(1, 9)}.{r.randint(0, 9)}'])}", f"{name()} {name()}, {pick(['Version', 'version'])} {r.randint(1, 9)}{pick(['', '.0', '.1'])}", f"{name()} {r.randint(1, 9)}.{r.randint(0, 9)}", f"{name()} {name()} {name()}, version {r.randint(1, 9)}.", f"{name()} {name()}, version {r.randint(1, 9)}.", f"{chars(2, upper[:26])} {chars(2, upper[:26])}-{chars(2, upper[:26])} {r.randint(1, 9)}.0", f"{r.randint(1, 99)}% {r.randint(1, 9)},{digits(3)} (20{digits(2)})", f"{name()} {name()} {name()}", f"{name()} {name()}", name(), name(), f"{name()}. {name()}", f"the {chars(3, upper[:26])} {name()}.", ".".join(str(r.randint(200, 999)) for _ in range(4)), f"{r.randint(2, 40)} {pick(words)}", f"BY-{chars(2, upper[:26])}", f"{pick(words)}/{pick(words)}", f"{pick(words)}-{pick(words)}", f"{syllables(2, 3)}_{syllables(1, 2)}()", "----", "***", "==",
        ])

    out = []
    for i in range(n):
        e = Example()
        again: list[str] = []

        def prose(e=e, again=again, most=20):
            at = r.randrange(len(words))
            if not e.tokens and r.random() < 0.8:  # as texts begin
                at = pick(firsts)
            for w in words[at : at + r.randint(1, most)]:
                if again and r.random() < 0.06:
                    e.add(pick(again) + pick(["", "", ".", ","]), NAME)
                e.add(w)

        for _ in range(r.randint(1, 4)):
            prose()
            mark = pick(["", "", "", ".", ",", "!!", ";"])
            what = r.choice([EMAIL, PHONE, PHONE, CARD, CARD, IP, IP, SECRET, SECRET, NAME, NAME, NAME, ID, ADDRESS, ADDRESS, *[O] * 10])
            if what == EMAIL:
                e.add(email() + mark, EMAIL)
            elif what == PHONE:
                e.add(phone() + mark, PHONE)
            elif what == CARD:
                d = number(pick([16, 16, 16, 15]), True)
                e.add(pick([d, d, grouped(d)]) + mark, CARD)
            elif what == IP:
                e.add(pick([".".join(str(r.randint(0, 255)) for _ in range(4)), ".".join(str(r.randint(0, 255)) for _ in range(4)), ":".join(chars(r.randint(1, 4), hexes) for _ in range(8)), f"{chars(4, hexes)}:{chars(4, hexes)}::{chars(r.randint(1, 4), hexes)}"]) + mark, IP)
            elif what == SECRET:
                text, labels = secret()
                e.add(text + mark, labels)
            elif what == ID:
                text, labels = ident()
                e.add(text + mark, labels)
            elif what == ADDRESS:
                text, labels = address()
                e.add(text + mark, labels)
            elif what == NAME:
                e.add(pick([pick(_TITLES), pick(_TITLES), "my name is", "My name is", "Name:", "signed by", "Contact:"]))
                who = [name() for _ in range(r.randint(1, 2))]
                for w in who[:-1]:
                    e.add(w, NAME)
                e.add(who[-1] + mark, NAME)
                again.append(who[-1])
            else:
                e.add(harmless() + mark)
        prose()
        if again:
            prose(most=30)
        out.append(e)
    return out


@dataclass
class Model:
    """Scores by label of features of a token (``own``), of its predecessor and successor, of neighbouring labels, and of equal labels along skip edges."""

    index: dict[str, int]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray
    skip: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 3 * K), np.float32))

    def rows(self, distinct: list[str]) -> np.ndarray:
        """(tokens, 3 K): what a token's features give its own labels, its successor's and its predecessor's. Remembered by token."""
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        new = [d for d in distinct if d not in self.known]
        if new:
            get, own, seen, sizes = self.index.get, [], [], np.zeros((2, len(new)), np.int64)
            for i, d in enumerate(new):
                mine, theirs = features(d)
                n = len(own), len(seen)
                own += [k for f in mine if (k := get(f)) is not None]
                seen += [k for f in theirs if (k := get(f)) is not None]
                sizes[:, i] = len(own) - n[0], len(seen) - n[1]
            out = np.zeros((len(new), 3 * K), np.float32)
            at = [np.repeat(np.arange(len(new)), x) for x in sizes]
            np.add.at(out[:, :K], at[0], self.own[own].astype(np.float32))
            np.add.at(out[:, K:], at[1], np.concatenate([self.before[seen], self.after[seen]], axis=1).astype(np.float32))
            first = len(self.table)
            self.table = np.concatenate([self.table, out])
            self.known.update(zip(new, range(first, first + len(new))))
        return self.table[[self.known[d] for d in distinct]]

    def scores(self, t: Tokens) -> np.ndarray:
        """(tokens, labels) scores of all tokens, without neighbours' labels."""
        if not len(t.kind):
            return np.zeros((0, K), np.float32)
        own, before, after = np.split(self.rows(t.distinct), 3, axis=1)
        out = own[t.kind]
        inside = np.flatnonzero(t.joined())
        out[inside + 1] += before[t.kind[inside]]
        out[inside] += after[t.kind[inside + 1]]
        at, names = t.runs()
        known = np.array([self.index.get(f, -1) for f in names], np.int64)
        if len(at):
            np.add.at(out, at[known >= 0], self.own[known[known >= 0]].astype(np.float32))
        return out

    def open(self, scores: np.ndarray, t: Tokens) -> np.ndarray:
        """Which tokens may be entities.

        The odds of a label against O are bounded from a token's own score and the most that messages can add. A
        neighbour's message is bounded by the neighbour's own odds, for which any neighbours are assumed; a skip edge
        can only add what a token at its other end has by itself, so it counts where that one's odds reach exp(-GATE).
        """
        step = self.step
        own = scores[:, 1:] - scores[:, :1]
        loose = own + ((step - step[:, :1]).max(0) + (step - step[:1]).max(1))[1:]
        odds = np.exp(np.minimum(loose, 30.0))
        inside = np.flatnonzero(t.joined())
        bound = own.copy()
        bound[inside + 1] += np.log(np.exp(step[0, 1:] - step[0, 0]) + odds[inside] @ np.exp(step[1:, 1:] - step[0, 0]))
        bound[inside] += np.log(np.exp(step[1:, 0] - step[0, 0]) + odds[inside + 1] @ np.exp(step[1:, 1:] - step[0, 0]).T)
        sure = (bound >= -GATE).any(1)
        if not sure.any():
            return sure
        some = np.flatnonzero((bound + 2 * self.skip.sum(0)[1:] >= -GATE).any(1) & ~sure)
        some = some[np.isin(t.document[some], np.unique(t.document[sure]))]
        out = sure.copy()
        for key in t.keys(np.concatenate([np.flatnonzero(sure), some])):
            m = int(sure.sum())
            place = t.document[np.concatenate([np.flatnonzero(sure), some])] * (int(key.max()) + 1) + key
            out[some[np.isin(place[m:], place[:m])]] = True
        return out

    def pair_scores(self, kind: np.ndarray) -> np.ndarray:
        """(edges, from, to) scores."""
        out = np.zeros((len(kind), K, K))
        out[kind == 0] = self.step
        for k in (1, 2):
            out[kind == k] = np.diag(self.skip[k - 1])
        return out

    def dump(self) -> bytes:
        return np.concatenate([x.ravel() for x in (self.own, self.before, self.after, self.step, self.skip)]).tobytes()

    @classmethod
    def load(cls, names: list[str], blob: bytes) -> Model:
        w, n = np.frombuffer(blob), len(names)
        cut = np.cumsum([n * K, n * K, n * K, K * K])
        own, before, after, step, skip = np.split(w, cut)
        return cls({f: i for i, f in enumerate(names)}, own.reshape(n, K), before.reshape(n, K), after.reshape(n, K), step.reshape(K, K), skip.reshape(2, K))


def train(made: list[Example]) -> Model:
    """The weights that maximise the pseudo-likelihood of the examples' labels, by gradient steps."""
    t = Tokens.of([" ".join(e.tokens) for e in made])
    y, n = np.array([x for e in made for x in e.labels], np.int64), len(t.kind)
    parts = [features(d) for d in t.distinct]
    index = {f: i for i, f in enumerate(sorted({f for p in parts for fs in p for f in fs} | set(t.runs()[1])))}
    numbers = [[np.array([index[f] for f in fs], np.int64) for fs in p] for p in parts]

    def flat(which: int, nodes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = [numbers[k][which] for k in t.kind[of]]
        return np.repeat(nodes, [len(x) for x in lists]), np.concatenate(lists)

    inside, every = np.flatnonzero(t.joined()), np.arange(n)
    run_at, run_names = t.runs()
    rows, cols = flat(0, every, every)
    sparse = [(np.concatenate([rows, run_at]), np.concatenate([cols, np.array([index[f] for f in run_names], np.int64)])), flat(1, inside + 1, inside), flat(1, inside, inside + 1)]
    edges = t.edges(every)
    m = Model(index, *(np.zeros((len(index), K)) for _ in range(3)), np.zeros((K, K)), np.zeros((2, K)))
    params = [m.own, m.before, m.after, m.step, m.skip]
    moved = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    truth, chain = np.eye(K)[y], edges[edges[:, 2] == 0]
    skips = [np.concatenate([e[:, :2], e[:, 1::-1]]) for e in (edges[edges[:, 2] == k] for k in (1, 2))]
    order = [(np.argsort(c, kind="stable"), *np.unique(np.sort(c), return_index=True)) for _, c in sparse]
    starts = [(np.argsort(r_, kind="stable"), *np.unique(np.sort(r_), return_index=True)) for r_, _ in sparse]
    for step_ in range(1, STEPS + 1):
        s = np.zeros((n, K))
        for (r_, c), w, (o, ids, first) in zip(sparse, params, starts):
            if len(c):
                s[ids] += np.add.reduceat(w[c[o]], first, axis=0)
        np.add.at(s, chain[:, 1], m.step[y[chain[:, 0]]])
        np.add.at(s, chain[:, 0], m.step[:, y[chain[:, 1]]].T)
        for k in (0, 1):
            a, b = skips[k].T
            np.add.at(s, (b, y[a]), m.skip[k][y[a]])
        p = np.exp(s - s.max(1, keepdims=True))
        d = (truth - p / p.sum(1, keepdims=True)) / n
        grads = [np.zeros_like(x) for x in params]
        for (r_, c), g, (o, ids, first) in zip(sparse, grads, order):
            if len(c):
                g[ids] = np.add.reduceat(d[r_[o]], first, axis=0)
        np.add.at(grads[3], y[chain[:, 0]], d[chain[:, 1]])
        np.add.at(grads[3].T, y[chain[:, 1]], d[chain[:, 0]])
        for k in (0, 1):
            a, b = skips[k].T
            np.add.at(grads[4][k], y[a], d[b, y[a]])
        for x, grad, (first_, second) in zip(params, grads, moved):
            grad -= DECAY * x / n * 100
            first_ *= 0.9
            first_ += 0.1 * grad
            second *= 0.99
            second += 0.01 * grad * grad
            x += RATE * (first_ / (1 - 0.9**step_)) / (np.sqrt(second / (1 - 0.99**step_)) + 1e-8)
        np.clip(m.skip, 0, MOST_SKIP, out=m.skip)
    return m


def marginals(scores: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = ROUNDS, group: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities by loopy belief propagation (exact where the graph has no cycle and ``rounds`` suffice).

    ``group`` numbers the graph that each node is of: the messages of a graph stop when they have settled, so its
    probabilities don't depend on the other graphs.
    """
    belief = scores.astype(np.float64)
    if len(edges):
        # Each edge has a message either way: source, target, and scores (source label, target label).
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        w = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(src), scores.shape[1]))
        group = np.zeros(len(scores), np.int64) if group is None else group
        of = group[src]
        live = np.arange(len(src))
        for r in range(rounds):
            new = np.empty((len(live), scores.shape[1]))
            for at in range(0, len(live), 100_000):
                i = live[at : at + 100_000]
                x = (belief[src[i]] - message[back[i]])[:, :, None] + w[i]
                top = x.max(1)
                new[at : at + len(i)] = top + np.log(np.exp(x - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            if r >= ROUNDS // 2:  # damped only where messages haven't settled by themselves
                new = (1 - DAMPING) * new + DAMPING * message[live]
            change = np.zeros(int(group.max()) + 1)
            np.maximum.at(change, of[live], np.abs(new - message[live]).max(1))
            np.add.at(belief, dst[live], new - message[live])
            message[live] = new
            live = live[change[of[live]] >= SETTLED]
            if not len(live):
                break
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def entities(texts: list[str | None], m: Model) -> list[tuple[int, int, int, str, float]]:
    """(text, start, end, label, score) in order; a run of neighbours of a label of ``RUNS`` is one entity, whose score is its least."""
    t = Tokens.of(texts)
    if not len(t.kind):
        return []
    scores = m.scores(t)
    open_ = m.open(scores, t)
    nodes = np.flatnonzero(open_)
    if not len(nodes):
        return []
    # A neighbour that is passed over is O.
    inside = np.flatnonzero(t.joined())
    shut = inside[~open_[inside]]
    scores[shut + 1] += m.step[O]
    shut = inside[~open_[inside + 1]]
    scores[shut] += m.step[:, O]
    edges = t.edges(nodes)
    p = marginals(scores[nodes], edges[:, :2], m.pair_scores(edges[:, 2]), group=t.document[nodes])
    label = np.where(p[:, 1:].max(1) >= THRESHOLD, 1 + p[:, 1:].argmax(1), O)
    found = np.flatnonzero(label)
    out: list[tuple[int, int, int, str, float]] = []
    first = np.searchsorted(t.document, np.arange(len(texts) + 1))
    starts: list[tuple[int, int]] = []
    doc, last = -1, -2
    for i in found:
        token = int(nodes[i])
        d = int(t.document[token])
        if d != doc:
            doc, starts = d, [x.span() for x in TOKEN.finditer(texts[d])]
        start, end = starts[token - int(first[d])]
        tok, k, score = t.distinct[t.kind[token]], int(label[i]), float(p[i, label[i]])
        lead = len(tok) - len(tok.lstrip(EDGE))
        start, end = start + lead, end - (len(tok) - len(tok.rstrip(EDGE))) if lead < len(tok) else end
        if k in RUNS and last == token - 1 and out and out[-1][0] == d and out[-1][3] == LABELS[k] and _goes_on(texts[d][out[-1][1] : out[-1][2]], tok, k):
            out[-1] = (d, out[-1][1], end, LABELS[k], min(out[-1][4], score))
        else:
            out.append((d, start, end, LABELS[k], score))
        last = token
    return out


def _goes_on(before: str, tok: str, label: int) -> bool:
    """Whether a token goes on with the entity of its label before it, and isn't another one."""
    if label == PHONE:
        return not tok.startswith("+")
    if label == CARD:
        return sum(c.isdigit() for c in before + tok) <= 19
    return True


def plain_words(texts: list[str]) -> list[str]:
    """The words of texts in their order, without what has a digit or a sign in it: that might be an entity."""
    return [w for t in sorted(texts) for w in t.split() if w.strip(EDGE).isalpha()]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_documents: int = MAX_TRAINING_DOCUMENTS) -> Model:
    """The model trained on :func:`examples` in words of at most ``max_documents`` documents."""
    ids = docs.select(quoted(id_col).cast("long").alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(max_documents)
    src = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text")).where("text is not null")
    found = src.join(F.broadcast(ids), "id").select("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = train(examples(plain_words([t for b in it for t in b.column(0).to_pylist()])))
        yield pa.RecordBatch.from_pydict({"names": pa.array([sorted(m.index, key=m.index.get)]), "w": pa.array([m.dump()], pa.binary())})

    r = map_arrow(found.repartition(1), run, "names array<string>, w binary").first()
    return train(examples([])) if r is None else Model.load(list(r.names), bytes(r.w))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, start, end, label, score): personal data and secrets in the documents, as [start, end) in characters.

    Null, empty and blank texts have none. Rows that repeat give their entities each; a null id stays null. Whole
    texts are read, however long. An empty table gives none; other columns are left out.
    """
    m = model or fit(docs, id_col, text_col)
    src = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at, texts in text_chunks(b, 1, 2_000_000):
                if found := entities(texts, m):
                    d, s, e, label, score = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array([at + i for i in d])), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(label), pa.array(score)],
                        ["doc_id", "start", "end", "label", "score"],
                    )

    return map_arrow(src, run, SCHEMA)
