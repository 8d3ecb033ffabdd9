"""Plain Python versions of the corpus operators, for comparison."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shingle_set(text, width=5):
    words = WORD.findall((text or "").translate(str.maketrans(UPPER, UPPER.lower())))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near(docs, percent=75):
    """docs: (doc_id, text). Returns doc_id -> (n, component)."""
    sets = [(i, shingle_set(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    by = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    seen = set()
    for members in by.values():
        for x in range(len(members)):
            for y in range(x + 1, len(members)):
                if (pair := (members[x], members[y])) in seen:
                    continue
                seen.add(pair)
                (i, a), (j, b) = sets[pair[0]], sets[pair[1]]
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def split_lines(text):
    """(number, trimmed line, words) of the lines that are not blank."""
    out = []
    for i, raw in enumerate(text.split("\n")):
        line = re.sub("[\t\x0b\x0c\r]", " ", raw).strip(" ")
        if line:
            out.append((i, line, len(line.split())))
    return out


def repeated_lines(docs, least=50):
    """docs: (doc_id, text), sorted. The (doc_id, line) that lie in a run of `least` words or more which also begins earlier."""
    lines = [(d, split_lines(t)) for d, t in docs if t is not None]
    gone = set()
    for x, (d, a) in enumerate(lines):
        for e, b in lines[: x + 1]:
            for delta in range(-len(b), len(a) + 1):
                run = []
                for k in range(len(a) + 1):
                    m = k - delta
                    same = k < len(a) and 0 <= m < len(b) and a[k][1] == b[m][1] and (d != e or m < k)
                    if same:
                        run.append(k)
                    else:
                        if sum(a[j][2] for j in run) >= least:
                            gone |= {(d, i) for i in range(a[run[0]][0], a[run[-1]][0] + 1)}
                        run = []
    return gone


def payload(text):
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


def digests(text):
    full = payload(text)
    return len((text or "").encode()), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])


def top(vectors, k=5):
    """vectors: (id, list or None). The contract's rows."""
    import math

    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def ngrams(text, bits):
    """Counts by bucket of the 2- and 3-grams of a text's letters, one after the other."""
    points = [ord(" ")] + [ord(c) if ord(c) > 127 or c.isalpha() else 32 for c in (text.lower().encode("utf-32-le", "surrogatepass").decode("utf-32-le", "surrogatepass"))] + [32]
    out, full = {}, 0xFFFFFFFF

    def pair(a, b):
        x = (a * 0x9E3779B1 ^ b * 0x85EBCA6B) & full
        return (x ^ x >> 15) * 0x2C1B3C6D & full

    for k in range(len(points) - 1):
        a, b = points[k : k + 2]
        if not a == b == 32:
            out[pair(a, b) >> 32 - bits] = out.get(pair(a, b) >> 32 - bits, 0) + 1
        if k + 2 < len(points):
            c = points[k + 2]
            if not (a == b == 32 or b == c == 32):
                x = (pair(a, b) ^ c * 0xC2B2AE35) * 0x297A2D39 & full
                out[x >> 32 - bits] = out.get(x >> 32 - bits, 0) + 1
    return out


def mixture(chances, counts, rounds):
    """Expectation-maximisation in plain Python: chances[i][k] of n-gram i in language k. Returns shares and log-likelihood."""
    import math

    width = len(chances[0])
    share = [1 / width] * width
    for _ in range(rounds if width > 1 else 0):
        new = [0.0] * width
        for row, n in zip(chances, counts):
            total = sum(p * s for p, s in zip(row, share))
            for k in range(width):
                new[k] += n * row[k] * share[k] / total
        new = [x / sum(counts) for x in new]
        done = max(abs(x - y) for x, y in zip(new, share)) < 1e-4
        share = new
        if done:
            break
    return share, sum(n * math.log(sum(p * s for p, s in zip(row, share))) for row, n in zip(chances, counts))


def language(text, names, logs, rounds, penalty, bits):
    """The prediction and its share, by the rules of llm.langid. logs[k][bucket]."""
    import math

    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    counts = ngrams(text, bits)
    at, n = list(counts), list(counts.values())
    top = [max(float(row[i]) for row in logs) for i in at]
    chance = [[math.exp(float(row[i]) - t) for row in logs] for i, t in zip(at, top)]
    share, _ = mixture(chance, n, rounds)
    order = sorted(range(len(names)), key=lambda k: -share[k])
    best, chosen, shares = -math.inf, order[:1], [1.0]
    for k in range(1, len(order) + 1):
        part, fitted = mixture([[row[j] + 1e-300 for j in order[:k]] for row in chance], n, rounds)
        cost = penalty * math.log(sum(n) + 1)
        if fitted - k * cost <= best:
            break
        best, chosen, shares = fitted - k * cost, order[:k], part
    name, found = min(((names[j], s) for j, s in zip(chosen, shares)), key=lambda x: (-round(x[1], 9), x[0]))
    return name, found


def differenced(sizes, parts):
    """Karmarkar-Karp on whole partial partitions: lists of (sum, members). Returns the part of each size."""
    import heapq

    heap = []
    for i, s in enumerate(sizes):
        row = sorted([(s, [i])] + [(0, [])] * (parts - 1), key=lambda x: -x[0])
        heapq.heappush(heap, (row[-1][0] - row[0][0], i, row))
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        row = sorted([(x + y, m + n) for (x, m), (y, n) in zip(a, b[::-1])], key=lambda x: -x[0])
        heapq.heappush(heap, (row[-1][0] - row[0][0], count, row))
        count += 1
    return sorted(s for s, _ in heap[0][2])


def mixed(rows, max_repeats):
    """rows: (key, source, tokens, deal, row hash, block place by epoch) of one corpus. Returns how often each key is used: the flattest
    mix that uses all and none more often than max_repeats, the part of an epoch taken in the permutation's order."""
    import math

    total = {}
    for _, s, n, *_ in rows:
        total[s] = total.get(s, 0) + n
    full = [t for t in total.values() if t]
    most, least = max(full), min(full)
    low, high = 0.0, 1.0
    flat = lambda x: (most / least) ** (1 - x) <= max_repeats
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if flat(middle) else (middle, high)
    exponent = 0.0 if flat(0.0) else high
    used = {}
    for source, t in total.items():
        times = (most / t) ** (1 - exponent) if t else 1.0
        whole = math.floor(times + 1e-9)
        paid, budget = 0, max(0, round((times - whole) * t))
        members = sorted((r for r in rows if r[1] == source), key=lambda r: (r[5][whole], r[3], r[4]))
        open_ = True
        for key, _, n, *_ in members:
            paid += n
            open_ = open_ and budget > 0 and paid <= budget
            used[key] = whole + open_
    return exponent, used
