"""The scanner: all rules over one text, in a few linear passes.

It runs in Arrow batches on the executors: normal forms with offsets and a sorted sweep over all hits have no built-in
expression, and a plan of one expression for each rule grows with the rules and folds over hits copy them again and
again. A scanner is plain data until a worker first uses it. A text that cannot be looked through is refused by itself:
``scan_many`` tells (hits, None) or (none, code of ``refused``) for each text.

Models see windows of all texts of a batch together. A window has at most ``window`` tokens where the model tells the places
of its tokens, characters else; neighbours share ``shared`` of them, so that what is not longer lies whole in one window, and
what two windows tell with the same span and type counts once, with the higher score.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

from maskframe.functions.checksums import CHECKS
from maskframe.functions.normalize import mapped

from .refused import Refused
from .rules import DOMAIN, FLOOR, GUARDED, LOCAL, LOCAL_AFTER_MARK, MARKS, STRENGTH, UUID, Rule, Terms
from .segments import CODE, runs, tiles

try:
    import ahocorasick
except ImportError:  # slower without it
    ahocorasick = None

#: Fixed value: longer texts than this are an error for users' patterns.
MAX_PATTERN_CHARS = 2_000_000
#: Fixed value: the most characters a model sees in one call.
MAX_MODEL_CHARS = 200_000
ALIAS_TYPE = "EXISTING_ALIAS"


class Hit(NamedTuple):
    """A found span in code points of the original text."""

    start: int
    end: int
    value: str
    normalized: str
    entity_type: str
    detector: str
    score: float
    priority: int
    profile: str
    policy: str
    ord: int


@dataclass(frozen=True)
class Model:
    """An entity model: ``find(text)`` tells (start, end, entity type, score). It sees prose only (unless ``in_code``),
    all parts of a text joined. In place of ``find``, ``load`` makes an object once in each worker process (told apart by
    ``detector``) with ``find_many(texts)`` and, where its tokenizer tells them, ``offsets(text)``, the places of the tokens."""

    detector: str
    find: Callable[[str], list[tuple[int, int, str, float]]] | None = None
    least: float = 0.7
    priority: int = 90
    in_code: bool = False
    #: words near which a PERSON keeps its full score; elsewhere it counts ``penalty`` of it
    words: tuple[str, ...] = ()
    penalty: float = 0.8
    load: Callable[[], object] | None = None
    #: tokens or characters of a window (None: the whole text), those shared by neighbours, and windows in one call
    window: int | None = None
    shared: int = 64
    batch: int = 32
    #: whether a text on which the model fails goes on without it; other detectors never may
    fail_open: bool = False


_loaded: dict[str, object] = {}


def loaded(model: Model) -> object:
    """What ``model`` loads, once in a process."""
    if model.detector not in _loaded:
        _loaded[model.detector] = model.load()
    return _loaded[model.detector]


def windows(text: str, size: int | None, shared: int, offsets: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """(start, end) in characters of the windows that cover a text, of at most ``size`` of its tokens (``offsets``) or characters."""
    n = len(offsets) if offsets else len(text)
    if not size or n <= size:
        return [(0, len(text))] if text else []
    out = []
    for first in range(0, max(1, n - shared), size - shared):
        last = min(first + size, n)
        out.append((offsets[first][0], offsets[last - 1][1]) if offsets else (first, last))
    return out


class Finder:
    """All occurrences, overlapping ones too, of many strings."""

    def __init__(self, values: dict[str, object]):
        self.values = values
        self.lengths = sorted({len(v) for v in values}, reverse=True)
        self.machine = None
        if ahocorasick and len(values) > 8:
            self.machine = ahocorasick.Automaton()
            for v in values:
                self.machine.add_word(v, v)
            self.machine.make_automaton()

    def all(self, text: str) -> Iterator[tuple[int, int, str]]:
        if self.machine is not None:
            for end, v in self.machine.iter(text):
                yield end + 1 - len(v), end + 1, v
        elif len(self.values) <= 8:
            for v in self.values:
                at = text.find(v)
                while at >= 0:
                    yield at, at + len(v), v
                    at = text.find(v, at + 1)
        else:
            for n in self.lengths:
                for at in range(len(text) - n + 1):
                    if text[at : at + n] in self.values:
                        yield at, at + n, text[at : at + n]

    def longest_first(self, text: str) -> list[tuple[int, int, str]]:
        """Occurrences from left to right, of those that start together the longest, none inside or across another."""
        out: list[tuple[int, int, str]] = []
        for a, b, v in sorted(self.all(text), key=lambda m: (m[0], -m[1])):
            if not out or a >= out[-1][1]:
                out.append((a, b, v))
        return out


def folded(text: str) -> tuple[str, list[int] | None]:
    """The text without case, and the character that each one of it comes from (None: the same places)."""
    whole = text.casefold()
    parts = [c.casefold() for c in text]
    if len(whole) == len(text) and all(len(p) == 1 for p in parts):
        return whole, None
    return "".join(parts), [k for k, p in enumerate(parts) for _ in p]


def ideographic(value: str) -> bool:
    return len(value) >= 2 and all("぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" for c in value)


class Dictionary:
    """The terms of several kinds on a normal form: one automaton for those whose case counts and one for the others, and a
    text is folded once for all of them."""

    def __init__(self, kinds: list[tuple[int, Terms]]):
        self.parts: list[tuple[bool, bool, Finder]] = []
        for ignore_case in (False, True):
            exact: dict[str, list[int]] = {}
            spaced: dict[str, list[int]] = {}
            for k, terms in kinds:
                if terms.ignore_case == ignore_case:
                    for v in terms.values:
                        exact.setdefault("".join(c.casefold() for c in v) if ignore_case else v, []).append(k)
                        if terms.spaced and ideographic(v):
                            spaced.setdefault(v, []).append(k)
            self.parts += [(ignore_case, blank, Finder(values)) for blank, values in ((False, exact), (True, spaced)) if values]

    def spans(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, number of the kind)."""
        low: tuple[str, list[int] | None] | None = None
        for ignore_case, blank, finder in self.parts:
            if blank:
                if " " not in text:
                    continue
                at = [k for k, c in enumerate(text) if c != " "]
                for a, b, v in finder.all(text.replace(" ", "")):
                    start, end = at[a], at[b - 1] + 1
                    if end - start > b - a and all(at[k + 1] - at[k] <= 2 for k in range(a, b - 1)):
                        for k in finder.values[v]:
                            yield start, end, k
                continue
            if ignore_case and low is None:
                low = (text.lower(), None) if text.isascii() else folded(text)
            t, src = low if ignore_case else (text, None)
            for a, b, v in finder.all(t):
                x, y = (a, b) if src is None else (src[a], src[b - 1] + 1)
                for k in finder.values[v]:
                    yield x, y, k


_DOMAIN, _UUID, _DIGITS = re.compile(DOMAIN), re.compile(UUID), re.compile(r"\d\d|\d[年月日./ -]\d")
_LOCAL, _LOCAL_MARKED, _MARK = re.compile(LOCAL), re.compile(LOCAL_AFTER_MARK), re.compile(MARKS)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses: first those without hiragana before the at sign, then those that begin at a mark or a line and
    end elsewhere. From each at sign on, so that long runs of letters are walked once."""
    ends = set()
    for strict in (True, False):
        last, at = 0, text.find("@")
        while at >= 0:
            start, allowed = at, _LOCAL if strict else _LOCAL_MARKED
            while start > last and allowed.match(text[start - 1]):
                start -= 1
            if not strict:
                start = next((k for k in range(start, at) if k == 0 or text[k - 1] == "\n" or _MARK.match(text[k - 1])), at)
            end = start < at and _DOMAIN.match(text, at + 1)
            if end:
                last = end.end()
                if strict or last not in ends:
                    yield start, last
                if strict:
                    ends.add(last)
            at = text.find("@", max(at + 1, last))


def blocks(marks: Iterator[re.Match]) -> Iterator[tuple[int, int]]:
    """From each mark of a beginning to the next one of an end; beginnings in between belong to the block."""
    start = None
    for m in marks:
        if m[1] == "BEGIN":
            start = m.start() if start is None else start
        elif start is not None:
            yield start, m.end()
            start = None


def safety(h: Hit) -> int:
    return max(STRENGTH.get(h.policy, 0), STRENGTH[FLOOR.get(h.entity_type, "literal")])


_NAMES = list(STRENGTH)


def resolved(hits: list[Hit]) -> list[Hit]:
    """The disjoint hits that win, by start. Stronger policy, priority, length, score, then earlier start, end and rule
    come first; a hit that overlaps one already taken goes. Spans of existing aliases take away what overlaps them and
    are not told themselves. Policies are raised to the least that the entity type allows."""
    shut = [(h.start, h.end) for h in hits if h.entity_type == ALIAS_TYPE]
    rest = [h for h in hits if h.entity_type != ALIAS_TYPE]
    if shut:
        joined: list[list[int]] = []
        for a, b in sorted(shut):
            if joined and a < joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        starts = [a for a, _ in joined]
        rest = [h for h in rest if not ((k := bisect_left(starts, h.end)) and joined[k - 1][1] > h.start)]
    # islands of hits that overlap one after another are settled by themselves, so that a long text stays linear
    out: list[Hit] = []
    island: list[Hit] = []
    reach = 0
    for h in [*sorted(rest, key=lambda h: (h.start, h.end)), None]:
        if h is not None and (not island or h.start < reach):
            island.append(h)
            reach = max(reach, h.end)
            continue
        if len(island) > 1:
            starts, ends = [], []
            for x in sorted(island, key=lambda x: (-safety(x), -x.priority, x.start - x.end, -x.score, x.start, x.end, x.ord)):
                k = bisect_right(starts, x.start)
                if (k == 0 or ends[k - 1] <= x.start) and (k == len(starts) or starts[k] >= x.end):
                    starts.insert(k, x.start)
                    ends.insert(k, x.end)
                    out.append(x)
        else:
            out += island
        island, reach = ([h], h.end) if h is not None else ([], 0)
    return sorted((h._replace(policy=_NAMES[safety(h)]) for h in out), key=lambda h: h.start)


@dataclass(frozen=True)
class Scanner:
    """Rules, dictionaries and models over one text at a time. ``twice`` settles the hits of each segment by themselves
    first; once is the default, as a hit that loses to one which loses later would be left in the clear."""

    rules: tuple[Rule | Terms | Model, ...]
    form: str = "NFKC"
    segment: bool = True
    twice: bool = False
    resolve: bool = True
    least: float = 0.0
    guard: tuple[str, ...] = field(default=GUARDED)
    max_chars: int | None = None

    @cached_property
    def _patterns(self) -> list[tuple[int, Rule, re.Pattern, tuple[str, ...], tuple[str, ...], bool, bool]]:
        out = []
        for k, r in enumerate(self.rules):
            if isinstance(r, Rule):
                hints = r.hints or (r.words if r.needs == "words" and not r.after else ())
                fold = "(?i)" in r.pattern or bool(hints and not r.hints and any(h.isascii() for h in hints))
                digits = not hints and r"\d" in r.pattern and r.detector != "user_regex"
                hints = tuple(h.lower() for h in hints) if fold else hints
                out.append((k, r, re.compile(r.pattern), hints, tuple(h for h in hints if h.isascii()), fold, digits))
        return out

    @cached_property
    def _dictionary(self) -> Dictionary:
        return Dictionary([(k, r) for k, r in enumerate(self.rules) if isinstance(r, Terms)])

    @cached_property
    def _models(self) -> list[tuple[int, Model]]:
        return [(k, r) for k, r in enumerate(self.rules) if isinstance(r, Model)]

    def _matches(self, t: str) -> Iterator[tuple[int, int, Rule | Terms, float, int]]:
        """(start, end, rule, score, ordinal) on a normal form."""
        low, plain, has_digits = t.lower(), t.isascii(), _DIGITS.search(t) is not None
        for k, r, pattern, hints, ascii_hints, fold, digits in self._patterns:
            if digits and not has_digits:
                continue
            if hints:
                where = low if fold else t
                for h in ascii_hints if plain else hints:
                    if h in where:
                        break
                else:
                    continue
            if r.detector == "user_regex" and len(t) > MAX_PATTERN_CHARS:
                raise Refused("PATTERN_TEXT_TOO_LONG")
            finder = r.extra.get("finder")
            found = addresses(t) if finder == "email" else blocks(pattern.finditer(t)) if finder == "blocks" else (m.span(r.group) for m in pattern.finditer(t))
            check = CHECKS[r.check] if r.check else None
            for a, b in found:
                if a == b or check and not check(t[a:b]):
                    continue
                score = r.score
                if r.words:
                    around = t[max(0, a - r.window) : b + r.window]
                    near = any(w in around for w in r.words) or bool(r.after) and any(w in t[b : b + 12] for w in r.after)
                    if r.needs and not near and not (r.mark and re.search(r.mark, t[a:b])):
                        continue
                    score = r.near if r.near and near else r.score
                if score >= self.least:
                    yield a, b, r, score, k
        for a, b, k in self._dictionary.spans(t):
            yield a, b, self.rules[k], 1.0, k

    def _guarded(self, text: str) -> Iterator[tuple[int, int, str, Rule | Terms, float, int]]:
        """(start, end, normal form, rule, score, ordinal) of the deterministic detectors, in the text's own offsets."""
        t, src, end = (text, None, None) if text.isascii() or unicodedata.is_normalized(self.form, text) else mapped(text, self.form)
        uuids = [m.span() for m in _UUID.finditer(t)] if t.count("-") >= 4 else []
        starts = [a for a, _ in uuids]
        for a, b, r, score, k in self._matches(t):
            if uuids and r.detector in self.guard and (i := bisect_right(starts, a)) and b <= uuids[i - 1][1] and b - a < uuids[i - 1][1] - uuids[i - 1][0]:
                continue
            x, y = (a, b) if src is None else (src[a], end[b - 1])
            yield x, y, t[a:b], r, score, k

    def _part(self, text: str, issued: Finder | None) -> list[Hit]:
        """Hits of the deterministic detectors in one part, in its own offsets."""
        out: dict[tuple, Hit] = {}
        for x, y, form, r, score, k in self._guarded(text):
            out.setdefault((r.detector, r.entity, x, y), Hit(x, y, text[x:y], form, r.entity, r.detector, score, r.priority, r.profile, r.policy, k))
        found = list(out.values())
        if issued:
            found += [Hit(a, b, v, v, ALIAS_TYPE, "existing_alias", 1.0, 300, "prose_identifier", "literal", -1) for a, b, v in issued.longest_first(text)]
        return found

    def _parts(self, text: str, kind: str) -> list[tuple[int, int, str]]:
        if self.max_chars is not None and len(text) > self.max_chars:
            raise Refused("TEXT_TOO_LONG")
        return runs(tiles(text)) if self.segment and kind == "prose" else [(0, len(text), kind)]

    def count(self, text: str | None, kind: str = "prose") -> Counter:
        """How many hits of each entity type the deterministic detectors have, before they are settled."""
        out: Counter = Counter()
        for a, b, _ in self._parts(text, kind) if text else ():
            spans = {(x, y, r.detector, r.entity) for x, y, _, r, _, _ in self._guarded(text[a:b])}
            out.update(entity for _, _, _, entity in spans)
        return out

    def _told(self, model: Model, texts: list[str]) -> list[list[tuple[int, int, str, float]] | None]:
        """What a model tells of each text, None where it fails. Windows of all texts go to it together; a call that fails
        is made again window by window, so that only its own text suffers."""
        own = loaded(model) if model.load else None
        cut = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(t, model.window, model.shared, own.offsets(t) if hasattr(own, "offsets") else None)]
        many = own.find_many if own is not None else lambda some: [model.find(t) for t in some]
        best: list[dict | None] = [{} for _ in texts]
        for first in range(0, len(cut), model.batch):
            some = cut[first : first + model.batch]
            try:
                found = many([texts[i][a:b] for i, a, b in some])
            except Exception:  # noqa: BLE001 - whatever a model raises
                found = []
                for i, a, b in some:
                    try:
                        found += many([texts[i][a:b]])
                    except Exception:  # noqa: BLE001
                        found.append(None)
            for (i, a, _), told in zip(some, found, strict=True):
                if told is None:
                    best[i] = None
                elif best[i] is not None:
                    for x, y, entity, score in told:
                        key = (x + a, y + a, entity)
                        best[i][key] = max(score, best[i].get(key, score))
        return [None if b is None else [(*key, score) for key, score in sorted(b.items())] for b in best]

    def _modelled(self, k: int, model: Model, texts: list[tuple[str, list[tuple[int, int, str]]]]) -> Iterator[list[Hit] | str]:
        """For each text (with its parts) the hits of a model, or the code for which it is refused. Parts that the model may
        see are joined by a blank line, and spans are clipped to each part."""
        own = [[p for p in parts if model.in_code or p[2] not in CODE] for _, parts in texts]
        joined = ["\n\n".join(text[a:b] for a, b, _ in parts) for (text, _), parts in zip(texts, own, strict=True)]
        asked = [i for i, j in enumerate(joined) if j.strip() and len(j) <= MAX_MODEL_CHARS]
        told = dict(zip(asked, self._told(model, [joined[i] for i in asked]), strict=True))
        for i, (text, _) in enumerate(texts):
            if len(joined[i]) > MAX_MODEL_CHARS:
                yield "MODEL_TEXT_TOO_LONG"
            elif (found := told.get(i, [])) is None:
                yield [] if model.fail_open else "MODEL_FAILED"
            else:
                yield list(self._clipped(k, model, text, own[i], joined[i], found))

    def _clipped(self, k: int, model: Model, text: str, parts: list[tuple[int, int, str]], joined: str, found: list) -> Iterator[Hit]:
        at, places = 0, []
        for a, b, _ in parts:
            places.append((at, at + b - a, a))
            at += b - a + 2
        ends = [last for _, last, _ in places]
        for x, y, entity, score in found:
            near = not model.words or any(w in joined[max(0, x - 20) : y + 20] for w in model.words)
            score *= model.penalty if entity == "PERSON" and not near else 1
            if score < model.least:
                continue
            for first, last, start in places[bisect_right(ends, x) :]:
                if first >= y:
                    break
                a, b = max(x, first) - first + start, min(y, last) - first + start
                yield Hit(a, b, text[a:b], unicodedata.normalize(self.form, text[a:b]), entity, model.detector, float(score), model.priority, "prose_identifier", "literal", k)

    def scan_many(self, texts: list[str | None], kinds: list[str | None] | None = None, issued: list[Finder | None] | None = None) -> list[tuple[list[Hit], str | None]]:
        """(hits, None) for each text, or (none, code) for one that is refused."""
        out: list[tuple[list[Hit], str | None]] = []
        cut: list[list] = []
        for i, text in enumerate(texts):
            found: list[Hit] = []
            parts, code = [], None
            try:
                parts = self._parts(text, kinds and kinds[i] or "prose") if text else []
                for a, b, _ in parts:
                    own = self._part(text[a:b], issued[i] if issued else None)
                    if self.twice:
                        own = resolved(own)
                    found += [h._replace(start=h.start + a, end=h.end + a) for h in own] if a else own
            except Refused as why:
                found, code = [], why.code
            except Exception:  # noqa: BLE001 - a detector that fails lets nothing through
                found, code = [], "DETECTOR_FAILED"
            out.append((found, code))
            cut.append(parts)
        for k, model in self._models:
            asked = [i for i, (_, code) in enumerate(out) if code is None and texts[i]]
            for i, told in zip(asked, self._modelled(k, model, [(texts[i], cut[i]) for i in asked]), strict=True):
                out[i] = ([], told) if isinstance(told, str) else (out[i][0] + told, None)
        return [(resolved(found) if self.resolve else found, code) for found, code in out]

    def scan(self, text: str | None, kind: str = "prose", issued: Finder | None = None) -> list[Hit]:
        """The hits of one text; an error if it is refused."""
        found, code = self.scan_many([text], [kind], [issued])[0]
        if code:
            raise Refused(code)
        return found
