"""Plain Python statements of the rules, for small inputs."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

from quire.functions.split import STOP_WORDS
from quire.functions.text import WS_CHARS

WS = "[" + re.escape(WS_CHARS) + "]"


def units(text):
    """One list item per UTF-16 unit."""
    data = text.encode("utf-16-le", "surrogatepass")
    return [data[i : i + 2] for i in range(0, len(data), 2)]


def from_units(items):
    return b"".join(items).decode("utf-16-le", "replace")


def is_heading(line):
    if re.match(rf"#{{1,6}}{WS}", line) or re.match(rf"[0-9]+(\.[0-9]+)*\.?{WS}+[A-Z]", line):
        return True
    allowed = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-:&,." + WS_CHARS)
    return 2 <= len(line) <= 100 and bool(re.match("[A-Z0-9]", line)) and set(line) <= allowed


def is_item(line):
    return any(
        re.match(p, line)
        for p in (rf"[-•▪◦*]{WS}", rf"\(?[a-zA-Z0-9]+\){WS}", rf"[0-9]+[A-Za-z]?[.)]{WS}")
    )


def joins(above, below):
    if not above or not below or is_heading(above) or is_item(below):
        return False
    return above[-1] not in ".!?:;" and not re.match("[A-Z][a-z]", below)


def normalize(text):
    text = re.sub("\r\n?", "\n", text).replace(" ", " ")
    text = "\n".join(line.rstrip(WS_CHARS) for line in text.split("\n"))
    text = re.sub("([A-Za-z])-\n([a-z])", r"\1\2", text)
    out = []
    for line in (re.sub("[ \t]+", " ", x).strip(WS_CHARS) for x in text.split("\n")):
        if out and joins(out[-1], line):
            out[-1] += " " + line
        else:
            out.append(line)
    return re.sub("\n{3,}", "\n\n", "\n".join(out)).strip(WS_CHARS)


def natural_end(text, end, least):
    """Where a piece that must end by ``end`` is cut; text is a list of units."""
    pair = lambda i: from_units(text[i : i + 2]) if i + 1 < len(text) else ""
    for marks, shift in ((("\n\n",), 0), ((". ", "? ", "! "), 1)):
        for at in range(end, least - 1, -1):
            if pair(at) in marks:
                return at + shift
    return end


def pieces(text, limit, back, overlap):
    text = units(text.strip(WS_CHARS))
    start = 0
    while start < len(text):
        end = min(start + limit, len(text))
        if end < len(text):
            end = natural_end(text, end, start + limit - back)
        yield start, end, from_units(text[start:end]).strip(WS_CHARS)
        if end == len(text):
            return
        start = end - overlap


def summary_pieces(text):
    return [p for p in pieces(text, 30000, 2000, 0) if p[2]]


def retrieval_pieces(text):
    kept = [p[2] for n, p in enumerate(pieces(text, 1200, 600, 200)) if n == 0 or len(units(p[2])) > 40]
    return kept


def terms(text):
    stop = set(STOP_WORDS)
    return Counter(t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) > 1 and t not in stop)


def search(text, question, k=4):
    """[(chunk index, similarity)] of the best k chunks."""
    chunks = [terms(c) for c in retrieval_pieces(text)]
    df = Counter(t for c in chunks for t in c)
    idf = {t: math.log((len(chunks) + 1) / (n + 0.5)) for t, n in df.items()}
    weigh = lambda c: {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    q = weigh(terms(question))
    scored = []
    for i, c in enumerate(chunks):
        w = weigh(c)
        size = norm(q) * norm(w)
        dot = sum(x * w.get(t, 0.0) for t, x in q.items())
        scored.append((i, round(dot / size, 12) if size else 0.0))
    return sorted(scored, key=lambda s: (-s[1], s[0]))[:k]


def quality(text):
    """Counts and ratios of one text."""
    flat = re.sub(f"{WS}+", " ", text).strip(" ")
    words = flat.split(" ") if flat else []
    n, size = len(words), len(units(flat))
    kind = [unicodedata.category(ch)[0] for ch in flat]
    letters = lambda w: all(unicodedata.category(ch)[0] == "L" for ch in w)

    def shaped(word, kinds):
        word = re.sub(r"[.,;:!?)]\Z", "", word)
        parts = re.split("['’-]", word)
        return all(p and all(unicodedata.category(ch)[0] in kinds for ch in p) for p in parts)

    def odd(word):
        low = "".join(ch for ch in word.lower() if unicodedata.category(ch)[0] == "L")
        flags = "".join(
            ("v" if ch in "aeiou" else "c") * len(units(ch)) for ch in low
        )
        return len(flags) >= 4 and ("ccccc" in flags or flags.startswith("cccc"))

    lexical = [w for w in words if letters(w)]
    seen = Counter(w.lower() for w in words)
    ratio = lambda a, b: a / b if b else 0.0
    return {
        "character_count": size,
        "word_count": n,
        "alphanumeric_ratio": ratio(sum(k in "LN" for k in kind), size),
        "printable_ratio": ratio(sum(ch >= " " and ch != "\x7f" for ch in flat), size),
        "suspicious_character_ratio": ratio(sum(ch == "�" or ch < " " for ch in flat), size),
        "average_word_length": ratio(sum(len(units(w)) for w in words), n),
        "word_like_ratio": ratio(sum(shaped(w, "LN") for w in words), n),
        "alphabetic_word_ratio": ratio(sum(shaped(w, "L") for w in words), n),
        "single_character_token_ratio": ratio(sum(len(units(w)) == 1 for w in words), n),
        "suspicious_word_ratio": ratio(sum(odd(w) for w in lexical), len(lexical)),
        "long_token_ratio": ratio(sum(len(units(w)) > 30 for w in words), n),
        "repeated_token_ratio": ratio(sum(c for c in seen.values() if c > 1), n) if n > 1 else 0.0,
        "vowel_ratio": ratio(len(re.findall("[aeiouAEIOU]", flat)), kind.count("L")),
    }


def saves(entries, limit=100):
    """Ids of a history after saving (id, created_at) one by one."""
    store = []
    for entry in entries:
        rest = sorted((e for e in store if e[0] != entry[0]), key=lambda e: e[1], reverse=True)
        store = [entry, *rest][:limit]
    return {e[0] for e in store}


def groups(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
