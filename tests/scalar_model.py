"""Plain Python models of single operators, written from their definitions; tests compare Spark with them."""

import hashlib
import math
import re
from collections import Counter


def strip_span(text, a, b):
    raw = text[a:b]
    body = raw.strip()
    first = a + len(raw) - len(raw.lstrip())
    return body, first, first + len(body)


def heading(line):
    m = re.fullmatch(r"(#+) (.*)", line.strip(), re.S)
    return (len(m[1]), m[2].strip()) if m and m[2].strip() else None


def windows(text, a, b, size, overlap):
    n = 1 if b - a <= size else math.ceil((b - a - size) / (size - overlap)) + 1
    cut = [strip_span(text, a + i * (size - overlap), min(b, a + i * (size - overlap) + size)) for i in range(n)]
    return [w for w in cut if w[0]]


def sections(text, title):
    found, at, cur = [], 0, (title, None, 0)
    for line in text.splitlines(keepends=True):
        h = heading(line)
        if h:
            found.append((*cur, at))
            cur = (h[1], h[0], at + len(line))
        at += len(line)
    found.append((*cur, len(text)))
    return [s for s in found if text[s[2] : s[3]].strip()] or [(title, None, 0, len(text))]


def blocks(text, title, markdown, size, overlap):
    out, at, section, run = [], 0, (title, None), []
    for line in [*text.splitlines(keepends=True), ""]:
        h = heading(line) if markdown else None
        if h or not line.strip():
            if run:
                body = "\n".join(x.rstrip() for _, x in run).strip()
                first, past = run[0][0], run[-1][0] + len(run[-1][1].rstrip("\r\n"))
                out += [(body, first, past, *section)] if len(body) <= size else [(*w, *section) for w in windows(text, first, past, size, overlap)]
                run = []
            section = (h[1], h[0]) if h else section
        else:
            run.append((at, line))
        at += len(line)
    return out


def chunks(path, text, strategy, size, overlap):
    if not text.strip():
        return []
    name = path.rsplit("/", 1)[-1]
    stem = name[: name.rindex(".")] if "." in name[1:] else name
    title = stem.replace("_", " ").strip() or name
    own = blocks(text, title, strategy == "markdown", size, overlap) if strategy != "fixed" else []
    out = []
    if not own:
        sec = sections(text, title)
        for body, a, b in windows(text, 0, len(text), size, overlap):
            s = next((s for s in sec if s[2] <= a < s[3]), sec[-1])
            out.append((body, a, b, s[0], s[1], "fixed"))
    s = 0
    while s < len(own):
        fits = [j for j in range(s, len(own)) if len("\n\n".join(x[0] for x in own[s : j + 1])) <= size and (strategy != "markdown" or all(own[t][3] == own[t - 1][3] for t in range(s + 1, j + 1)))]
        stop = max([s, *fits]) + 1
        group = own[s:stop]
        out.append(("\n\n".join(x[0] for x in group), group[0][1], group[-1][2], group[-1][3], group[-1][4], strategy))
        if stop == len(own):
            break
        back = [i for i in range(s + 1, stop) if sum(len(x[0]) for x in own[i:stop]) >= overlap]
        s = max(back, default=s + 1)
    return [(f"{path}::chunk-{i}", path, t or title, body, i, a, b, (a, b, kind, title, t, level)) for i, (body, a, b, t, level, kind) in enumerate(out)]


def terms(text):
    return [t.lower() for t in re.findall(r"[A-Za-z0-9_]+", text or "")]


def hash_vector(text):
    v = [0.0] * 128
    for token in (text or "").lower().split():
        for i, b in enumerate(hashlib.sha256(token.encode()).digest()[:16]):
            v[(b + 17 * i) % 128] += 1 if b % 2 == 0 else -1
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def bm25(docs, query):
    counts = [Counter(terms(d)) for d in docs]
    lengths = [sum(c.values()) for c in counts]
    average = sum(lengths) / len(docs) if docs else 0
    df = Counter(t for c in counts for t in c)
    out = []
    for c, n in zip(counts, lengths):
        out.append(sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * n / average)) for t in terms(query) if c[t]) if average else 0.0)
    return out


def cosine(a, b):
    below = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / below if below and len(a) == len(b) else 0.0
