"""Expected matches of one document, worked out on plain Python lists."""

import re

from gazewatch import fixed

PATTERNS = [re.compile(p, re.IGNORECASE) for p in fixed.TITLE_PATTERNS]
DATE = re.compile(fixed.DATE_PHRASE, re.IGNORECASE)


def titles_of(lines):
    """Line number -> title for all lines but the first."""
    found = {}
    for number in range(1, len(lines)):
        hits = [m for m in (p.search(lines[number].strip()) for p in PATTERNS) if m]
        if hits:
            found[number] = hits[0].group().strip()
    return found


def act_at(lines, titles, number, back, forward):
    """(start, end, title or None) of the act around a line."""
    above = [t for t in titles if number - back < t <= number]
    start = max(above, default=number)
    below = [t for t in titles if start < t < start + forward]
    return start, min(below, default=len(lines)), titles[start] if above else None


def matches(text, orgao, keywords, back=50, forward=200):
    """List of (keyword, line, title, date, snippet, full text)."""
    if orgao.lower() not in text.lower():
        return []
    lines = text.split("\n")
    titles = titles_of(lines)
    found = []
    for keyword in keywords:
        seen = set()
        for number, line in enumerate(lines):
            if keyword.lower() not in line.lower():
                continue
            start, end, title = act_at(lines, titles, number, back, forward)
            full = "\n".join(lines[start:end]).strip()
            shown = title or full[:200].replace("\n", " ").strip()
            if shown in seen:
                continue
            seen.add(shown)
            dated = DATE.search(title) if title else None
            found.append(
                (keyword, number, shown, dated.group() if dated else "", full[:500], full)
            )
    return found
