"""Plain Python versions of the operators, written from their contracts."""

import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = (
    ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, places = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                places |= {i, i + 1, i + 2}
    n, rep = len(words), len(places)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def secrets(text):
    text = text or ""
    found = []
    for k, (name, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), k, m.end(), name) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    count = [sum(1 for x in found if x[1] == k) for k in range(3)]
    told = ",".join(f"{name}:{s}:{e}" for s, _, e, name in sorted(found))
    return (*count, hashlib.sha256(told.encode()).hexdigest(), told)


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, radius=3):
    """rows: (id, fingerprint). Smallest id reachable, by comparing all pairs of distinct fingerprints."""
    least = {}
    for i, f in rows:
        least[f] = min(least.get(f, i), i)
    fps = sorted(least)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    best = {}
    for f in fps:
        best[find(f)] = min(best.get(find(f), least[f]), least[f])
    return {i: best[find(f)] for i, f in rows}


def crc32(text):
    return zlib.crc32((text or "").encode())


def conversations(rows):
    """rows: (conv_id, turn, role, text). conv_id to (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        told = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def language(text, model, family_of):
    """(language, family, score) by loops over the bytes of one text."""
    if not any(c.isalpha() for c in text or ""):
        return "und", "und", 0.0
    data = []
    for c in (text or "").encode():
        letter = 97 <= c <= 122 or c >= 128
        data.append(c + 32 if 65 <= c <= 90 else c if letter else 32)
    data = [32, *data, 32]
    chance = {}
    for j, (group, a, b) in enumerate(model.pairs):
        total = 0.0
        for k, n in enumerate((2, 3, 4)):
            for i in range(len(data) - n + 1):
                h = 0
                for c in data[i : i + n]:
                    h = (h * 257 + c) % 2**32
                total += float(model.weights[((h * 2654435761) % 2**32 >> 20) + k * 4096][j])
        x = max(-30.0, min(30.0, total / len(data) * float(model.scale[j])))
        chance[group, a, b] = 1 / (1 + math.exp(-x))

    def vote(group, names):
        best = None
        for v in names:
            won, sure = 0.0, 1.0
            for (g, a, b), p in chance.items():
                if g == group and v in (a, b):
                    own = p if v == a else 1 - p
                    won += own / 100 + ((p >= 0.5) == (v == a))
                    sure = min(sure, own)
            if best is None or (won, v) > best[:2]:
                best = (won, v, sure)
        return best[1], best[2]

    family, s = vote("family", model.families)
    lang, t = vote(family, [x for x in model.langs if family_of(x) == family])
    return lang, family, min(s, t)
