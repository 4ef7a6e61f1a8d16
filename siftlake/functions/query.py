"""Query front end: search prefixes, search modes, natural-language dates, line selections and small parsers."""

from __future__ import annotations

import calendar
import re
import secrets
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from siftlake.schemas import FILE_KINDS

SCOPES, MATCHES = ("line", "file", "doc"), ("fuzzy", "exact", "regex")
_SCOPE_WORDS = {"file": "file", "doc": "doc", "document": "doc"}

# --- search prefixes ---


@dataclass
class PrefixQuery:
    query: str
    scope: str | None = None
    match: str | None = None
    kinds: list[str] = field(default_factory=list)
    source: str | None = None
    path_prefix: str | None = None
    error: str | None = None
    only_prefixes: bool = False
    tokens: list[str] = field(default_factory=list)


def tokenize(raw: str) -> list[str]:
    """Tokens between blanks and tabs; double quotes keep blanks inside a token (an open quote runs to the end)."""
    return re.findall(r'(?:"[^"]*(?:"|$)|[^ \t"])+', raw)


def parse_prefixes(raw: str) -> PrefixQuery:
    """`file: doc: document: exact: regex: type:<kind> source:<name>[/path]`, in any order; the last of a sort wins.

    Scope and match prefixes may be chained in one token. An unknown prefix or kind is ordinary text. If only prefixes
    are left, the query is the raw text and only_prefixes is set.
    """
    found, words, tokens = PrefixQuery(""), [], tokenize(raw.strip())
    for token in tokens:
        head, colon, tail = token.partition(":")
        if colon and head.lower() == "source":
            name, _, below = tail.strip("/").partition("/")
            if name:
                found.source, found.path_prefix = name, below
                found.tokens.append(token)
            else:
                found.error = f'"{token}" should read source:name or source:name/path'
            continue
        if colon and head.lower() == "type" and tail.lower() in FILE_KINDS:
            found.kinds.append(tail.lower())
            found.tokens.append(token)
            continue
        rest, modifiers = token, 0
        while m := re.match(r"(file|document|doc|exact|regex):", rest, re.IGNORECASE):
            word, rest, modifiers = m[1].lower(), rest[m.end() :], modifiers + 1
            if word in _SCOPE_WORDS:
                found.scope = _SCOPE_WORDS[word]
            else:
                found.match = word
        if modifiers:
            found.tokens.append(token)
        if rest:
            words.append(rest)
    text = " ".join(words)
    found.only_prefixes = bool(tokens) and not text.strip()
    found.query = text if text.strip() else raw.strip()
    return found


def has_searchable_content(raw: str) -> bool:
    """At least three characters other than white space remain besides prefixes."""
    found = parse_prefixes(raw)
    return not found.only_prefixes and len(re.sub(r"\s", "", found.query)) >= 3


def to_mode(scope: str, match: str) -> str:
    """Name of the search mode of a scope and a match type."""
    if scope == "doc":
        return "document" if match == "fuzzy" else f"doc-{match}"
    return match if scope == "line" else f"file-{match}"


def from_mode(mode: str) -> tuple[str, str]:
    """Scope and match type of a mode; an unknown mode is a fuzzy line search."""
    known = {to_mode(s, m): (s, m) for s in SCOPES for m in MATCHES}
    return known.get(mode, ("line", "fuzzy"))


# --- natural-language dates ---


@dataclass
class DateQuery:
    query: str
    date_from: int | None = None
    date_to: int | None = None
    phrase: str | None = None


_MONTHS = {name.lower(): i for i in range(1, 13) for name in (calendar.month_name[i], calendar.month_abbr[i])}
_DAYS = {name.lower(): i for i in range(7) for name in (calendar.day_name[i], calendar.day_abbr[i])}
_NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {"a": 1, "an": 1, "few": 3}
_UNIT = r"(?:second|minute|hour|day|week|weekend|month|quarter|year)s?"
_MONTH = "|".join(sorted(_MONTHS, key=len, reverse=True))
_DAY = "|".join(sorted(_DAYS, key=len, reverse=True))
_COUNT = "|".join([r"\d+", *_NUMBERS])
_DATE = re.compile(
    rf"""\b(?:
    (?P<iso>\d{{4}}-\d{{2}}-\d{{2}})
  | (?P<word>today|yesterday|now)
  | (?:last|past|previous)\s+(?P<n>{_COUNT})\s+(?P<units>{_UNIT})
  | (?P<ago>{_COUNT})\s+(?P<ago_units>{_UNIT})\s+ago
  | (?P<rel>last|past|previous|this)\s+(?P<unit>{_UNIT})
  | (?:(?P<rel_day>last|this)\s+)?(?P<weekday>{_DAY})
  | (?P<month>{_MONTH})(?:\s+(?P<mday>\d{{1,2}})(?:st|nd|rd|th)?(?!\d))?(?:,?\s+(?P<myear>\d{{4}}))?
  | (?P<year>(?:19|20)\d{{2}})
    )\b""",
    re.IGNORECASE | re.VERBOSE,
)
_LEAD = re.compile(r"\b(?:(?:in|on|since|before|after|between|from|until|during|last|next|past|over|the|within)\s+)+$", re.IGNORECASE)
_STOP = {"a", "an", "the", "and"}


def end_of_day(t: datetime) -> datetime:
    return t.replace(hour=23, minute=59, second=59, microsecond=0)


def start_of_day(t: datetime) -> datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def previous_week(now: datetime) -> tuple[datetime, datetime]:
    """Monday to Sunday of the calendar week before."""
    monday = start_of_day(now) - timedelta(days=now.weekday() + 7)
    return monday, end_of_day(monday + timedelta(days=6))


def previous_weekend(now: datetime) -> tuple[datetime, datetime]:
    """Saturday and Sunday of the last completed weekend; on a Saturday, that of a week ago."""
    saturday = start_of_day(now) - timedelta(days=(now.weekday() - 5) % 7 or 7)
    return saturday, end_of_day(saturday + timedelta(days=1))


def _months_back(t: datetime, n: int) -> datetime:
    at = t.year * 12 + t.month - 1 - n
    year, month = at // 12, at % 12 + 1
    return t.replace(year=year, month=month, day=min(t.day, calendar.monthrange(year, month)[1]))


def _back(t: datetime, n: int, unit: str) -> datetime:
    unit = unit.lower().rstrip("s")
    if unit in ("month", "quarter", "year"):
        return _months_back(t, n * {"month": 1, "quarter": 3, "year": 12}[unit])
    return t - n * timedelta(**{{"weekend": "weeks"}.get(unit, unit + "s"): 1})


def _month_span(year: int, month: int) -> tuple[datetime, datetime]:
    first = datetime(year, month, 1, tzinfo=timezone.utc)
    return first, end_of_day(first.replace(day=calendar.monthrange(year, month)[1]))


def _year_span(year: int) -> tuple[datetime, datetime]:
    return datetime(year, 1, 1, tzinfo=timezone.utc), datetime(year, 12, 31, 23, 59, 59, tzinfo=timezone.utc)


@dataclass
class _Date:
    """A phrase with the point it names and the whole period it stands for."""

    start: int
    stop: int
    point: datetime
    first: datetime
    last: datetime
    relative: bool


def _dates(text: str, now: datetime) -> list[_Date]:
    out = []
    for m in _DATE.finditer(text):
        g, relative = m.groupdict(), False
        if g["iso"]:
            try:
                first = datetime.fromisoformat(g["iso"]).replace(tzinfo=timezone.utc)
            except ValueError:
                continue
            point, last = first, now
        elif g["word"]:
            day = now - timedelta(days=g["word"].lower() == "yesterday")
            point, first = day, day if g["word"].lower() == "now" else start_of_day(day)
            last = end_of_day(day) if g["word"].lower() == "yesterday" else now
        elif g["n"] or g["ago"]:
            n, unit, relative = (g["n"] or g["ago"]).lower(), g["units"] or g["ago_units"], True
            point = first = _back(now, int(n) if n.isdigit() else _NUMBERS[n], unit)
            last = now
        elif g["rel"]:
            unit, relative = g["unit"].lower().rstrip("s"), g["rel"].lower() != "this"
            point = _back(now, int(relative), unit)
            if unit == "week" and relative:
                first, last = previous_week(now)
            elif unit == "weekend" and relative:
                first, last = previous_weekend(now)
            elif unit == "month":
                first, last = _month_span(point.year, point.month)
            elif unit == "year":
                first, last = _year_span(point.year)
            else:
                first, last = point, now
        elif g["weekday"]:
            days = (now.weekday() - _DAYS[g["weekday"].lower()]) % 7 or 7
            point = first = start_of_day(now) - timedelta(days=days)
            last = end_of_day(first) if g["rel_day"] else now
        elif g["month"]:
            month = _MONTHS[g["month"].lower()]
            year = int(g["myear"]) if g["myear"] else now.year - (month > now.month)
            first, last = _month_span(year, month)
            if g["mday"] and 1 <= int(g["mday"]) <= last.day:
                first, last = first.replace(day=int(g["mday"])), now
            point = first
        else:
            first, last = _year_span(int(g["year"]))
            point = first
        out.append(_Date(m.start(), m.end(), point, first, last, relative))
    return out


def parse_dates(raw: str, mode: str, now: datetime) -> DateQuery:
    """Take a date phrase and stop words out of a query. `now` is an aware UTC time.

    Regex modes keep everything; exact modes keep stop words. Quoted text is left alone. A range that runs backwards
    is not used, and a query that would become empty stays as it was.
    """
    if mode.endswith("regex"):
        return DateQuery(raw)
    quoted = re.findall(r'"[^"]*"', raw)
    counter = iter(range(len(quoted)))
    text = re.sub(r'"[^"]*"', lambda _: f"\x00{next(counter)}\x00", raw)
    found, span, first, last = _dates(text, now), None, None, None
    if len(found) == 1:
        d = found[0]
        before = text[: d.start]
        lead = _LEAD.search(before)
        span = (lead.start() if lead else d.start, d.stop)
        rolling = d.relative and re.search(r"\b(in|within)\b", before, re.IGNORECASE)
        if re.search(r"\b(before|until|by)\s*$", before, re.IGNORECASE):
            last = d.point
        elif re.search(r"\b(since|after)\s*$", before, re.IGNORECASE):
            first, last = d.point, now
        else:
            first, last = (d.point, now) if rolling else (d.first, d.last)
    elif len(found) > 1:
        a, b = found[0], found[-1]
        if text[a.stop : b.start].strip().lower() in ("and", "to", "-"):
            lead = re.search(r"\b(between|from)\s+$", text[: a.start], re.IGNORECASE)
            span, first, last = (lead.start() if lead else a.start, b.stop), a.first, b.last
    if first and last and first > last:
        span = first = last = None
    phrase = text[span[0] : span[1]].strip() if span else None
    if span:
        text = " ".join((text[: span[0]] + " " + text[span[1] :]).split())
    if not mode.endswith("exact"):
        text = " ".join(w for w in text.split() if w.lower() not in _STOP)
    text = re.sub("\x00(\\d+)\x00", lambda m: quoted[int(m[1])], text).strip()
    if not text:
        return DateQuery(raw)
    return DateQuery(text, int(first.timestamp()) if first else None, int(last.timestamp()) if last else None, phrase)


# --- line selections and small parsers ---


def parse_selection(fragment: str) -> list[tuple[int, int]]:
    """Ranges of `#L20-30,43`; an invalid fragment has none. Ends in either order."""
    body = re.fullmatch(r"#?L(\d+(?:-L?\d+)?(?:,L?\d+(?:-L?\d+)?)*)", fragment)
    if not body:
        return []
    out = []
    for part in body[1].replace("L", "").split(","):
        a, _, b = part.partition("-")
        out.append((min(int(a), int(b or a)), max(int(a), int(b or a))))
    return out


def format_selection(ranges: list[tuple[int, int]]) -> str:
    return "#L" + ",".join(str(a) if a == b else f"{a}-{b}" for a, b in ranges) if ranges else ""


def parse_ttl(text: str) -> int:
    """Seconds of `Nd` or `Nh`; 0 means for ever."""
    m = re.fullmatch(r"(\d+)([dh])", text.strip())
    if not m and text.strip() != "0":
        raise ValueError(f"{text!r} is neither days (30d) nor hours (12h)")
    return int(m[1]) * {"d": 86_400, "h": 3_600}[m[2]] if m else 0


def parse_clock(text: str) -> tuple[int, int]:
    m = re.fullmatch(r"(\d{1,2}):(\d{2})", text.strip())
    if not m or int(m[1]) > 23 or int(m[2]) > 59:
        raise ValueError(f"{text!r} is no time of day")
    return int(m[1]), int(m[2])


def until_next(clock: tuple[int, int], now: datetime) -> timedelta:
    """Time until the clock shows these hours and minutes next; a full day if it does now."""
    at = now.replace(hour=clock[0], minute=clock[1], second=0, microsecond=0)
    return at - now if at > now else at + timedelta(days=1) - now


def version_at_least(version: str, least: str) -> bool:
    parts = lambda v: [int(x) for x in re.findall(r"\d+", v)[:3]] + [0] * 3
    return parts(version)[:3] >= parts(least)[:3]


def link_code(length: int = 6) -> str:
    """A share code without letters and digits that look alike."""
    alphabet = [c for c in map(chr, range(48, 123)) if c.isalnum() and c not in "01IOlo"]
    return "".join(secrets.choice(alphabet) for _ in range(length))


def include_prefixes(patterns: list[str]) -> list[str] | None:
    """Literal folders that include patterns start with; None if one of them allows any folder (no pruning)."""
    out = set()
    for pattern in patterns:
        parts = pattern.replace("\\", "/").lstrip("/").split("/")
        literal = []
        for part in parts[:-1]:
            if re.search(r"[*?\[{]", part):
                break
            literal.append(part)
        if pattern.startswith("!") or not literal:
            return None
        out.add("/".join(literal))
    return sorted(out)


def glob_to_regex(pattern: str) -> str:
    """Regular expression of a glob over `/` paths; `p/**` matches p itself too."""
    pattern = pattern.replace("\\", "/")
    tail = ""
    if pattern.endswith("/**"):
        pattern, tail = pattern[:-3], "(/.*)?"
    out = ""
    for part in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]+\]|\{[^}]*\}|.", pattern):
        if part in ("**/", "**"):
            out += "(.*/)?" if part == "**/" else ".*"
        elif part == "*":
            out += "[^/]*"
        elif part == "?":
            out += "[^/]"
        elif part[0] == "[" and len(part) > 1:
            out += part.replace("[!", "[^")
        elif part[0] == "{" and len(part) > 1:
            out += "(" + "|".join(re.escape(p) for p in part[1:-1].split(",")) + ")"
        else:
            out += re.escape(part)
    return f"^{out}{tail}$"
