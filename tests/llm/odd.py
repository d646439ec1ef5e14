"""Small odd tables, and plain-Python versions of what the operators compute."""

from __future__ import annotations

import collections
import hashlib
import re

#: Columns that clash with names the operators use inside.
CLASHING = "row bigint, d string, x string, split string, key string, kept boolean, n_words string, token_ids string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"

WORDS = [f"w{i}" for i in range(400)]


def sentence(start: int, count: int = 40) -> str:
    return " ".join(WORDS[(start + 7 * i) % len(WORDS)] for i in range(count))


def texts() -> list[tuple[int | None, str | None]]:
    shared = "This line stands in Many documents."
    long = " ".join(sentence(i, 30) for i in range(0, 390, 3))
    rows = [
        (1, None),
        (2, ""),
        (3, "  \t\n \x0b\x0c\r "),
        (4, "one two"),
        (5, "ONE two"),
        (6, sentence(1)),
        (7, sentence(1) + " more"),
        (8, sentence(1).upper()),
        (9, sentence(1)),
        (10, f"{shared}\n{sentence(9)}\n  {shared.upper()}\t\nÉtÉ"),
        (11, f"x\n{shared}\n\n{sentence(17)}"),
        (12, f"{shared} \n{sentence(23)}\n{shared}\n"),
        (13, long),
        (14, "é" * 700 + " " + sentence(31)),
        (15, sentence(41) + " " + sentence(51)),
        (16, sentence(61) + " " + sentence(41)),
        (17, "a" * 1200),
        (18, " nbsp wide　 " + sentence(71, 12)),
        (19, "### $$$ |||| %% && ** word word word <> # " * 4),
        (20, "again and again and again and again and again and again and again and again"),
        (21, "</s>[INST] <|endoftext|> \U0001f600 'S don't it's\r\n\r\n  tail  "),
        (None, sentence(1)),
        (None, None),
        (None, f"{shared}\nnull id"),
    ]
    rows += [(22, sentence(81)), (22, sentence(81)), (23, long)]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    extra = (5, "d", "x", "s", "k", False, "n", "t")
    full = [(i, t, "en", "src", None if t is None else len(t), *extra) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def fold(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None) -> set:
    w = words(fold(text))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def measures(text: str | None) -> tuple:
    text = text or ""
    w = words(text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def passes(text: str | None) -> bool:
    n, chars, symbols, dup_lines, repeats = measures(text)
    base = n < 10 or 100 * repeats > 20 * n
    return not (base or 10 * symbols > n or chars < 2 * n or chars > 20 * n or 20 * dup_lines > n)


def smaller(a, b) -> bool:
    """Null ids are smaller than others."""
    return b is not None and (a is None or a < b)


def kept_lines(rows) -> list[tuple[int, list[str]]]:
    """(lines, kept lines) of each row."""
    key = lambda line: fold(line.strip(" \t\n\x0b\x0c\r"))
    found = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                found[key(line)].add(i)
    last = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in found.items() if len(ids) >= 3}
    made = []
    for i, text in rows:
        lines = (text or "").split("\n")
        made.append((len(lines), [x for x in lines if key(x) not in last or last[key(x)] == i]))
    return made


def components(rows, percent: int) -> dict[int, int]:
    """Smallest reachable id by id; ids are distinct but for repeated rows, null ids are left out."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def contained(rows, items, percent: int = 80) -> set:
    found = set()
    for i, text in rows:
        own = shingles(text)
        for item, passage in items:
            wanted = shingles(passage)
            if wanted and 100 * len(own & wanted) >= percent * len(wanted):
                found.add((i, item, len(wanted), len(own & wanted)))
    return found


def without_windows(rows, window: int) -> list[tuple[int, int, str]]:
    """(words, removed, kept text) of each row; rows with one id are one place if their text is equal."""
    places = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    first: dict[tuple, tuple] = {}
    for p in places:
        w = words(p[2])
        for at in range(len(w) - window + 1):
            first.setdefault(tuple(w[at : at + window]), (p, at))
    made = []
    for i, t in rows:
        p, w = (i is not None, i or 0, t or ""), words(t)
        gone = set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] != (p, at):
                gone.update(range(at, at + window))
        made.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return made


def without_strings(rows, length: int) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, spans, sha256 of the rest) of each row."""
    data = [(t or "").encode() for _, t in rows]
    count = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    made = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        made.append((len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return made


def by_text(rows):
    return sorted(rows, key=str)
