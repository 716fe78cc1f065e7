"""Personal data in texts: fixed rules, and a semi-Markov conditional random field beside them.

The rules (``base_spans``) find mail addresses, IP addresses, payment cards and phone
numbers of plain form.  Numbers that stand side by side run together in them and
are lost, and other ways to write the same things aren't known to them.  The
random field adds such spans.  It scores whole candidate segments (digits and how they
are grouped, separators, check digit, what stands around, cue words), and dynamic
programming over the boundaries of a stretch of text picks the segments and their
kinds that score best together, those between them being outside.  Entities are
bounded (MOST_RUNS runs of digits), so the work is linear in the text.

The field is trained here, by maximum likelihood, on sentences that ``examples`` makes
up; it doesn't depend on the corpus, so a document's spans don't either.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import slices, whole_number

KINDS = ("email", "ip", "card", "phone")
#: Runs of digits in one segment, separators between two of them, digits of a segment, and labels of a mail domain, at most.
MOST_RUNS, MOST_GAP, MOST_DIGITS, MOST_LABELS = 8, 4, 19, 4

# The forms of the contract.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match never starts inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Digits and all that may stand between those of one segment; no segment of digits leaves its stretch.
_STRETCH = re.compile(r"[0-9+(][0-9()\[\].+/:\x20-]*")
_RUN = re.compile(r"[0-9]+")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i & 1:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def stretches(text: str) -> list[tuple[int, int]]:
    """Where digits may form something: stretches with four digits or more."""
    return [(m.start(), m.end()) for m in _STRETCH.finditer(text) if m.end() - m.start() > 3 and len(_NO_DIGIT.sub("", m.group())) > 3]


def base_spans(text: str, numbers: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, ascending; kinds by number.

    Matches of a kind are leftmost and don't overlap; those whose parts, digits or
    check digit fail are dropped, and nothing is tried again inside them.
    """
    found, end = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                found.append((start, 0, end))
    for low, high in stretches(text) if numbers is None else numbers:
        for m in _IP.finditer(text, low, high):
            if all(map(_octet, m.group().split("."))):
                found.append((m.start(), 1, m.end()))
        if high - low < 8:
            continue
        for m in _CARD.finditer(text, low, high):
            if m.end() - m.start() > 13:
                digits = _NO_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, low, high):
            if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# Candidate segments and their features ------------------------------------------------------------------------------
CUES = {
    **dict.fromkeys("phone tel telephone telefon telefono téléphone teléfono tél call fax mobile mobil cell ring handy móvil portable whatsapp".split(), "phone"),
    **dict.fromkeys("card visa mastercard amex credit debit karte kreditkarte carte tarjeta pan cc".split(), "card"),
    **dict.fromkeys("ip host server login address adresse client from proxy node".split(), "ip"),
    **dict.fromkeys("order invoice isbn issn id no nr ref reference serial sku version article account case ticket eur usd".split(), "number"),
}
ENDINGS = frozenset("com org net edu gov io co info biz eu de fr es it uk us ch at nl be pl ru cn jp in br ca au example dev app me".split())
_WORDS_BEFORE = re.compile(r"[^\W\d_]+")
_MAIL_SIGNS = ("@", "at)", "AT)", "at]", "AT]", "at}", " dot ", " DOT ")
_MAIL = re.compile(
    r"(?<![\w.%+-])(?P<local>[\w.%+-]{1,64})(?P<at>\x20?@\x20?|\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)(?P<domain>\w[\w-]*(?:(?:\.\x20?|\x20\.\x20|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20)\w[\w-]*)+)", re.IGNORECASE
)
_DOT = re.compile(r"\.\x20?|\x20\.\x20|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20", re.IGNORECASE)
_HEX = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:(?=[0-9A-Fa-f:])|::)[0-9A-Fa-f:]*[0-9A-Fa-f](?![\w:])")


def _side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "none"
    c = text[at]
    return "letter" if c.isalpha() or c == "_" else "digit" if c.isdigit() else "blank" if c.isspace() else c if c in "+-./:@=#$%(),;\"'" else "sign"


def _cue(text: str, start: int) -> str:
    for word in reversed(_WORDS_BEFORE.findall(text[max(0, start - 24) : start])[-3:]):
        if (cue := CUES.get(word.lower())) is not None:
            return cue
    return "none"


def number_segments(text: str, low: int, high: int) -> Iterator[tuple[int, int, int, list[str]]]:
    """(start, end, kind, features) of the segments of digits in a stretch."""
    runs = [m.span() for m in _RUN.finditer(text, low, high)]
    for a, (first, _) in enumerate(runs):
        if _side(text, first - 1) == "letter":
            continue
        n, lengths, gaps = 0, [], []
        for b in range(a, min(len(runs), a + MOST_RUNS)):
            start, end = runs[b]
            if b > a:
                gap = text[runs[b - 1][1] : start]
                if len(gap) > MOST_GAP:
                    break
                gaps.append(gap)
            n += end - start
            lengths.append(end - start)
            if n > MOST_DIGITS:
                break
            if n < 4 or _side(text, end) == "letter":
                continue
            octets = b - a == 3 and n <= 12 and all(g.strip(" ") in (".", "[.]", "(.)") for g in gaps) and all(_octet(text[x:y]) for x, y in runs[a : b + 1])
            if n < 7 and not octets:
                continue
            begins = [first]
            if text[first - 1 : first] in ("(", "+") and first > low:
                begins.append(first - 1)
                if text[first - 2 : first] == "+(" and first - 1 > low:
                    begins.append(first - 2)
            digits = _NO_DIGIT.sub("", text[first:end])
            after = "run" if b + 1 < len(runs) and runs[b + 1][0] - end == 1 and text[end] in " -" else "joined" if b + 1 < len(runs) and runs[b + 1][0] - end == 1 else "free"
            for begin in begins:
                before = "run" if a and begin - runs[a - 1][1] == 1 and text[begin - 1] in " -" else "joined" if a and begin - runs[a - 1][1] == 1 else "free"
                inner = text[begin:end]
                even = inner.count("(") == inner.count(")")
                shape = "-".join(map(str, lengths)) if len(lengths) < 7 else "many"
                kinds = {g.replace(" ", "_") for g in gaps}
                parts = [
                    "any", f"n={n}", f"shape={shape}", f"lead={inner[0] if inner[0] in '+(' else 'digit'}", f"gaps={' '.join(sorted(kinds))}", f"mixed={min(3, len(kinds))}",
                    f"even={even}", f"left={_side(text, begin - 1)}", f"right={_side(text, end)}", f"before={before}", f"after={after}", f"cue={_cue(text, begin)}", f"cue={_cue(text, begin)} shape={shape}",
                    f"lead={inner[0] in '+('} shape={shape}", f"runs={len(lengths)}",
                ]
                if octets:
                    yield begin, end, 1, [f"ip {x}" for x in parts]
                if 13 <= n and inner[0] not in "+(":
                    good = luhn(digits)
                    yield begin, end, 2, [f"card {x}" for x in [*parts, f"luhn={good}", f"luhn={good} n={n}", f"luhn={good} first={digits[0] if digits[0] in '3456' else 'other'}"]]
                if 7 <= n <= 15:
                    yield begin, end, 3, [f"phone {x}" for x in parts]


def mail_segments(text: str) -> Iterator[tuple[int, int, int, list[str]]]:
    """Segments that look like mail addresses, with each number of labels of the domain."""
    at = 0
    while (m := _MAIL.search(text, at)) is not None:
        sign, begin = m["at"].lower(), m.start()
        how = "plain" if sign == "@" else "blank" if "@" in sign else "word" if sign == " at " else "bracket"
        cuts = list(_DOT.finditer(text, *m.span("domain")))
        for k in range(1, min(len(cuts), MOST_LABELS) + 1):
            end = cuts[k].start() if k < len(cuts) else m.end("domain")
            label = text[cuts[k - 1].end() : end]
            dots = sorted({"." if x == "." else "bracket" if x.strip()[:1] in "([{" else "word" if "dot" in x.lower() else "loose" for x in (c.group() for c in cuts[:k])})
            last = "known" if label.lower() in ENDINGS else "letters" if label.isalpha() and 2 <= len(label) <= 6 else "other"
            more = "none" if k == len(cuts) else "known" if text[cuts[k].end() : cuts[k + 1].start() if k + 1 < len(cuts) else m.end("domain")].lower() in ENDINGS else "other"
            parts = ["any", f"at={how}", f"dots={' '.join(dots)}", f"at={how} dots={' '.join(dots)}", f"last={last}", f"at={how} last={last}", f"at={how} dots={' '.join(dots)} last={last}", f"more={more}", f"labels={k}", f"left={_side(text, begin - 1)}", f"case={label[:1].isupper()}"]
            yield begin, end, 0, [f"email {x}" for x in parts]
        at = m.end("at")  # another address may begin among the labels


def hex_segments(text: str) -> Iterator[tuple[int, int, int, list[str]]]:
    """Segments that look like IP addresses of eight groups, one stretch of zeros left out or not."""
    for m in _HEX.finditer(text):
        found = m.group()
        groups = found.split(":")
        if len(found) > 39 or any(len(g) > 4 for g in groups) or found.count("::") > 1 or ":::" in found:
            continue
        whole = len(groups) == 8 and "" not in groups or "::" in found and len(groups) <= 8
        parts = ["any6", f"whole={whole}", f"groups={len([g for g in groups if g])}", f"left={_side(text, m.start() - 1)}", f"letters={any(c.isalpha() for c in found)}"]
        yield m.start(), m.end(), 1, [f"ip {x}" for x in parts]


def segments(text: str, numbers: list[tuple[int, int]]) -> list[tuple[int, int, int, list[str]]]:
    found = [s for low, high in numbers for s in number_segments(text, low, high)]
    if any(x in text for x in _MAIL_SIGNS):
        found.extend(mail_segments(text))
    if "::" in text or text.count(":") > 6:
        found.extend(hex_segments(text))
    return sorted(found, key=lambda s: s[:3])


def clusters(found: list[tuple]) -> Iterator[list[tuple]]:
    """Segments, ascending, in groups that touch; a gap of a few characters belongs to a group, as entities there are neighbours."""
    group, end = [], -1
    for s in found:
        if group and s[0] > end + MOST_GAP:
            yield group
            group, end = [], -1
        group.append(s)
        end = max(end, s[1])
    if group:
        yield group


# The random field ---------------------------------------------------------------------------------------------------
class Field:
    """Weights of features, and of a kind after the kind before it in its cluster (0: none before)."""

    def __init__(self, weights: dict[str, float], after: list[list[float]]):
        self.weights, self.after = weights, after

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(x, 0.0) for x in features)

    def best(self, group: list[tuple]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the segments that score best together.  A state is a boundary and the last kind before it."""
        places = sorted({x for s in group for x in s[:2]})
        number = {x: i for i, x in enumerate(places)}
        ending: list[list] = [[] for _ in places]
        for start, end, kind, features in group:
            ending[number[end]].append((number[start], kind, self.score(features)))
        none = (-math.inf, None)
        table = [[(0.0, None)] + [none] * len(KINDS)]
        for i in range(1, len(places)):
            row = list(table[i - 1])  # one step outside
            for start, kind, score in ending[i]:
                for last, (value, path) in enumerate(table[start]):
                    if value + score + self.after[last][kind] > row[kind + 1][0]:
                        row[kind + 1] = (value + score + self.after[last][kind], ((places[start], kind, places[i]), path))
            table.append(row)
        path, out = max(table[-1], key=lambda x: x[0])[1], []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return out[::-1]


def _expected(places: int, segs: list[tuple[int, int, int]], scores: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each segment (start, end, kind) and of each step from kind to kind, by forward and backward sums."""
    weight, step, states = np.exp(scores), np.exp(after), len(KINDS) + 1
    forward, backward = np.zeros((places, states)), np.zeros((places, states))
    forward[0, 0] = 1.0
    order = sorted(range(len(segs)), key=lambda i: segs[i][1])
    at = 0
    for p in range(1, places):
        forward[p] += forward[p - 1]
        while at < len(order) and segs[order[at]][1] == p:
            s, _, kind = segs[order[at]]
            forward[p, kind + 1] += weight[order[at]] * (forward[s] @ step[:, kind])
            at += 1
    backward[-1] = 1.0
    order.sort(key=lambda i: -segs[i][0])
    at = 0
    for p in range(places - 2, -1, -1):
        backward[p] += backward[p + 1]
        while at < len(order) and segs[order[at]][0] == p:
            _, e, kind = segs[order[at]]
            backward[p] += weight[order[at]] * step[:, kind] * backward[e, kind + 1]
            at += 1
    total, odds, steps = forward[-1].sum(), np.zeros(len(segs)), np.zeros_like(after)
    for i, (s, e, kind) in enumerate(segs):
        each = forward[s] * step[:, kind] * (weight[i] * backward[e, kind + 1] / total)
        odds[i] = each.sum()
        steps[:, kind] += each
    return odds, steps


def fit(labelled: list[tuple[str, list[tuple[int, int, int]]]], *, rounds: int = 40, rate: float = 0.5, shrink: float = 0.02) -> Field:
    """The field that makes (text, [(start, kind, end)]) likeliest, by gradient ascent with steps scaled for each weight.

    A cluster with an entity that is no candidate is left out, as no weights could find it.
    """
    names: dict[str, int] = {}
    data = []
    for text, gold in labelled:
        wanted = set(gold)
        for group in clusters(segments(text, stretches(text))):
            held = {(s, k, e) for s, e, k, _ in group}
            low, high = min(s[0] for s in group), max(s[1] for s in group)
            if any(low < e and s < high and (s, k, e) not in held for s, k, e in wanted):
                continue
            places = {x: i for i, x in enumerate(sorted({x for s in group for x in s[:2]}))}
            ids = [np.array([names.setdefault(f, len(names)) for f in features]) for *_, features in group]
            chosen = np.array([float((s, k, e) in wanted) for s, e, k, _ in group])
            steps, last = np.zeros((len(KINDS) + 1, len(KINDS))), 0
            for s, e, k, _ in group:
                if (s, k, e) in wanted:
                    steps[last, k] += 1
                    last = k + 1
            data.append((len(places), [(places[s], places[e], k) for s, e, k, _ in group], np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids]), chosen, steps))
    w, after = np.zeros(len(names)), np.zeros((len(KINDS) + 1, len(KINDS)))
    sum_w, sum_after = np.full(len(names), 1e-6), np.full(after.shape, 1e-6)
    for _ in range(rounds):
        up, up_after = -shrink * w, -shrink * after
        for places, segs, ids, owner, chosen, steps in data:
            scores = np.bincount(owner, w[ids], len(segs))
            odds, taken = _expected(places, segs, scores, after)
            up += np.bincount(ids, (chosen - odds)[owner], len(names))
            up_after += steps - taken
        sum_w += up * up
        sum_after += up_after * up_after
        w += rate * up / np.sqrt(sum_w)
        after += rate * up_after / np.sqrt(sum_after)
    return Field({x: round(float(w[i]), 6) for x, i in names.items()}, np.round(after, 6).tolist())


# What it is trained on ----------------------------------------------------------------------------------------------
def _card_number(rng: random.Random, n: int) -> str:
    digits = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def _number(rng: random.Random, n: int) -> str:
    return rng.choice("123456789") + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _fours(digits: str, gap: str) -> str:
    return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(("an", "ter", "on", "re", "sh", "o", "li", "mar", "da", "é", "ü")) for _ in range(rng.randint(1, 4)))


def _entity(rng: random.Random) -> tuple[int, str, str]:
    """(kind, text, cue that must stand before it)."""
    kind = rng.randrange(4)
    n = lambda k: _number(rng, k)
    if kind == 0:
        plain = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8)))
        local, labels = plain() + rng.choice(("", "." + plain(), f".{n(2)}")), [plain() for _ in range(rng.randint(1, 2))]
        labels.append(rng.choice(("com", "org", "net", "de", "fr", "es", "io", "edu")))
        at, dot = rng.choice((("@", "."), ("@", "."), (" @ ", "."), (" (at) ", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("@", " dot "), ("@", "[dot]")))
        if at == "@" and dot == "." and rng.random() < 0.3:
            labels[0] += "ü" + plain()
        return 0, local + at + dot.join(labels), ""
    if kind == 1:
        if rng.random() < 0.25:
            groups = ["%x" % rng.randrange(1, 65536) for _ in range(8)]
            return 1, rng.choice((":".join(groups), ":".join(groups[:4]) + "::" + groups[7], groups[0] + "::" + groups[7])), ""
        return 1, rng.choice((".", ".", "[.]", " . ")).join(str(rng.randrange(1, 256)) for _ in range(4)), ""
    if kind == 2:
        digits = _card_number(rng, rng.choice((16, 16, 16, 16, 15)))
        if len(digits) == 15:
            gap = rng.choice((" ", "-", "."))
            return 2, rng.choice((digits, gap.join((digits[:4], digits[4:10], digits[10:])))), ""
        return 2, _fours(digits, rng.choice(("", "", "", " ", "-", ".", "/"))), ""
    form = rng.randrange(9)
    if form < 3:
        return 3, f"+{rng.choice('1234567')} ({n(3)}) {n(3)}-{n(4)}", ""
    if form == 3:
        return 3, f"({n(3)}) {n(3)}-{n(4)}", ""
    if form == 4:
        return 3, rng.choice("-.").join((n(3), n(3), n(4))), ""
    if form == 5:
        gap = rng.choice(" -.")
        return 3, gap.join((f"+{n(2)}", n(3), n(rng.choice((3, 4))), n(rng.choice((3, 4))))), ""
    if form == 6:
        return 3, f"0{n(rng.choice((2, 3)))}{rng.choice(('/', ' ', '-'))}{n(rng.choice((6, 7, 8)))}", rng.choice(("tel", "phone", "Telefon", "call", "mobile"))
    if form == 7:
        return 3, n(10), rng.choice(("tel", "phone", "call", "fax", "Tel.", "mobile:"))
    return 3, f"+{n(11)}", ""


def _other(rng: random.Random) -> str:
    """Something with digits or dots that is nobody's."""
    n = lambda k: _number(rng, k)
    bad = next(x for x in iter(lambda: n(16), "") if not luhn(x))
    return rng.choice((
        n(rng.randint(1, 6)), n(rng.randint(7, 12)), bad, _fours(bad, " "), n(20), f"{rng.randint(1900, 2100)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1900, 2100)}",
        f"{rng.randint(1900, 2030)}-{rng.randint(2031, 2100)}", f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", f"${n(1)},{n(3)},{n(3)}.{n(2)}", f"{n(3)} {n(3)} {n(3)}", f"{n(1)}.{n(2)}.{n(1)}", f"v{n(1)}.{n(2)}.{n(1)}",
        f"order {n(9)}", f"invoice {n(10)}", f"ISBN 978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"{n(3)}.{n(3)}.{n(3)},{n(2)}", "%040x" % rng.getrandbits(160), f"{n(2)} {n(2)} {n(2)} {n(2)} {n(2)}", f"at {_word(rng)}. {_word(rng).title()}", f"{_word(rng)} at {_word(rng)}.com", f"@{_word(rng)}", f"{n(4)} {n(4)}", f"{n(5)}-{n(4)}",
        f"300.{n(3)}.400.{n(2)}", f"a::{_word(rng)}", f"{n(1)}:{n(2)}", f"id {n(11)}", f"{n(3)}-{n(2)}-{n(3)}",
    ))


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """``n`` made-up sentences with their entities, alone or side by side, and numbers that are none."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.randint(1, 4)):
            text += "".join(_word(rng) + rng.choice((" ", " ", " ", ", ", ". ")) for _ in range(rng.randint(0, 4)))
            side_by_side = rng.choice((0, 1, 1, 1, 2, 2, 3))
            if not side_by_side:
                text += _other(rng) + rng.choice((" ", ". ", ", ", "\n"))
            for _ in range(side_by_side):
                if rng.random() < 0.15:
                    text += n + " " if (n := str(rng.randrange(1, 3000))) else ""
                kind, found, cue = _entity(rng)
                text += f"{cue} " if cue else ""
                gold.append((len(text), kind, len(text) + len(found)))
                text += found + rng.choice((" ", " ", " ", ", ", ". ", "\n"))
        text += "".join(_word(rng) + " " for _ in range(rng.randint(0, 3)))
        out.append((text, gold))
    return out


#: Sentences of the training, and the seed that they are made with.
EXAMPLES, SEED = 900, 13


@cache
def trained() -> Field:
    return fit(examples(EXAMPLES, SEED))


def find_spans(text: str, field: Field) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, by rule) of all spans of a text, ascending; those that the field adds overlap none of the rules'."""
    numbers = stretches(text)
    base = base_spans(text, numbers)
    out = [(*x, True) for x in base]
    covered = []  # by the rules; spans of two kinds may overlap
    for start, _, end in base:
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    free, at = [], 0
    for seg in segments(text, numbers):
        while at < len(covered) and covered[at][1] <= seg[0]:
            at += 1
        if at == len(covered) or covered[at][0] >= seg[1]:
            free.append(seg)
    for group in clusters(free):
        out.extend((*x, False) for x in field.best(group))
    return sorted(out)


SPANS = "doc_id long, spans array<struct<kind: string, start: int, end: int, by_rule: boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("by_rule", pa.bool_())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, by_rule) of every row of ``docs``, by start, then kind.

    Offsets are code points, ends exclusive.  A null text counts as empty, a null
    doc_id stays null, repeated rows each give a row, other columns are ignored; an
    empty table gives an empty one.  Spans of the rules may overlap where
    their kinds differ.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trained())  # a few thousand weights

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            for part in slices(batch, 1):
                found = [[{"kind": KINDS[k], "start": s, "end": e, "by_rule": r} for s, k, e, r in find_spans(t, field)] if t else [] for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(found, pa.list_(_SPAN))], schema=_SPANS)

    return docs.select(whole_number(docs["doc_id"]).alias("doc_id"), "text").mapInArrow(read, SPANS)


def digests(found: DataFrame) -> DataFrame:
    """The spans of ``personal_data`` as counts of the rules' matches, a digest of these, and a string of all."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["by_rule"])

    def counted(kind: str):
        return F.size(F.filter("spans", lambda s: s["by_rule"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(counted, KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["by_rule"])).cast("long").alias("n_added"))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
