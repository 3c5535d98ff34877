"""Plain versions of the contracts, over all documents in memory."""

import hashlib
from collections import defaultdict


def words(text):
    return (text or "").encode().split()


def substring(docs, window=35):
    seen = defaultdict(list)
    ws = [words(t) for _, t in docs]
    for d, w in enumerate(ws):
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])].append((d, i))
    gone = [set() for _ in docs]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + window))
    out = []
    for (doc_id, _), w, g in zip(docs, ws, gone, strict=True):
        kept = b" ".join(x for i, x in enumerate(w) if i not in g)
        out.append((doc_id, len(w), len(g), hashlib.sha256(kept).hexdigest()))
    return out


def contamination(docs, items, window=10):
    import re

    def split(text):
        low = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= own
        found = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


def linked(docs, width=4, percent=85):
    """(doc_id, set size, smallest id of the component) over all pairs."""
    sets = []
    for _, text in docs:
        w = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()).split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        r = find(i)
        least[r] = min([x for x in (least.get(r), doc_id) if x is not None], default=None)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)]


def _patience(a, b, i=0, j=0):
    """Aligned places (x, y) of two lists: equal ends, then piles of the lines that are unique in both, then what lies between."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, j), *_patience(a[1:], b[1:], i + 1, j + 1)]
    if a[-1] == b[-1]:
        return [*_patience(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
    cards = [(x, b.index(line)) for x, line in enumerate(a) if a.count(line) == 1 and b.count(line) == 1]
    piles = []  # each card remembers the top of the pile before it
    for card in cards:
        n = sum(1 for p in piles if p[-1][0][1] < card[1])
        entry = (card, piles[n - 1][-1] if n else None)
        if n < len(piles):
            piles[n].append(entry)
        else:
            piles.append([entry])
    chain, top = [], piles[-1][-1] if piles else None
    while top:
        chain.insert(0, top[0])
        top = top[1]
    out, x0, y0 = [], 0, 0
    for x, y in chain:
        out += [*_patience(a[x0:x], b[y0:y], i + x0, j + y0), (i + x, j + y)]
        x0, y0 = x + 1, y + 1
    return [*out, *_patience(a[x0:], b[y0:], i + x0, j + y0)] if chain else []


def line_dedup(docs, least=5, blocks=False):
    """blocks: documents meet through lines of ``least`` words, or through runs of two lines or more that have so many and no shorter such run at one end."""
    import sys

    sys.setrecursionlimit(20_000)
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    lines = [(t or "").encode().split(b"\n") if t else [] for _, t in docs]
    key = [[x.strip() for x in own] for own in lines]
    first = {}
    for i in order:
        for x in key[i]:
            if x:
                first.setdefault(x, i)
    count = lambda x: len(x.split())
    runs = [set() for _ in docs]
    for i in order if blocks else ():
        for a in range(len(key[i])):
            size = 0
            for b in range(a, len(key[i])):
                size += count(key[i][b])
                if b > a and size >= least:
                    runs[i].add(tuple(key[i][a : b + 1]))
                    break
        for b in range(len(key[i])):
            size = 0
            for a in range(b, -1, -1):
                size += count(key[i][a])
                if b > a and size >= least:
                    runs[i].add(tuple(key[i][a : b + 1]))
                    break
        for x in runs[i]:
            first.setdefault(x, i)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        gone = set()
        for other in {first[x] for x in [*(x for x in key[i] if x and (not blocks or count(x) >= least)), *runs[i]]} - {i}:
            places = _patience(key[other], key[i])  # blank lines match each other
            while places:
                n = next((n for n in range(1, len(places)) if places[n] != (places[0][0] + n, places[0][1] + n)), len(places))
                run, places = [y for _, y in places[:n]], places[n:]
                if sum(len(key[i][y].split()) for y in run) >= least:
                    gone.update(run)
        kept = b"\n".join(x for j, x in enumerate(lines[i]) if j not in gone)
        out.append((doc_id, len(lines[i]), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def language_model(docs, order, grid):
    """docs: (text, train, held out). The log10 probability of each text, by counts in dictionaries."""
    import math
    from collections import Counter

    texts = [["<", *words((t or "").encode().lower().decode()), ">"] for t, _, _ in docs]

    def counted(flags):
        out = [Counter() for _ in range(order + 1)]
        for w, f in zip(texts, flags, strict=True):
            for k in range(1, order + 1):
                out[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1) if f)
        tokens = {t: n for t, n in out[1].items() if t != ("<",)}
        return out, sum(tokens.values()), len(tokens)

    def estimates(w, i, counts, n, v):
        p, top, bucket = [1 / (v + 1), counts[1][w[i],] / max(n, 1)], 1, 0
        for k in range(2, order + 1):
            seen = counts[k - 1][tuple(w[i - k + 1 : i])] if i >= k - 1 else 0
            p.append(counts[k][tuple(w[i - k + 1 : i + 1])] / seen if seen else 0.0)
            if seen:
                top, bucket = k, int(math.log2(seen))
        return p, top, bucket

    kept = counted([train and not held for _, train, held in docs])
    rows = defaultdict(Counter)
    for w, (_, train, held) in zip(texts, docs, strict=True):
        for i in range(1, len(w) if train and held else 0):
            p, top, bucket = estimates(w, i, *kept)
            near = [p[0], *(2 ** (round(math.log2(x) * grid) / grid) if x > 0 else 0.0 for x in p[1 : top + 1])]
            rows[top, bucket][tuple(near)] += 1
            rows[top, None][tuple(near)] += 1

    def mixed(seen, size):
        weights, before = [1 / size] * size, -math.inf
        for _ in range(200):
            expected, likelihood = [1.0] * size, 0.0
            for p, times in seen.items():
                joint = [a * b for a, b in zip(p, weights, strict=True)]
                likelihood += times * math.log(sum(joint))
                expected = [e + j * times / sum(joint) for e, j in zip(expected, joint, strict=True)]
            weights = [e / sum(expected) for e in expected]
            if likelihood - before <= 1e-9 * abs(likelihood):
                break
            before = likelihood
        return weights

    fitted = {key: mixed(seen, key[0] + 1) for key, seen in rows.items()}
    full, out = counted([train for _, train, _ in docs]), []
    for w in texts:
        total = 0.0
        for i in range(1, len(w)):
            p, top, bucket = estimates(w, i, *full)
            weights = fitted.get((top, bucket)) or fitted.get((top, None)) or [1 / (top + 1)] * (top + 1)
            total += math.log10(sum(a * b for a, b in zip(weights, p, strict=False)))
        out.append(total)
    return out


def toxicity(model, text: str | None) -> float:
    """The score of a text by its definition: every window of words compressed twice, the bytes that the toxic dictionary saves counted."""
    import math

    import zstandard

    if not model.weights:
        return model.prior
    words = (text or "").encode().lower().split()
    windows = [words[i : i + model.width] for i in range(0, len(words), model.width)]

    def size(window: bytes, dictionary: bytes) -> int:
        settings = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY2, window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=4, target_length=32, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=settings)
        return len(zstandard.ZstdCompressor(dict_data=raw, compression_params=settings).compress(window))

    saved = []
    for window in windows:
        line = b" " + b"  ".join(window) + b" "
        saved.append(size(line, model.ordinary) - size(line, model.toxic + model.ordinary))
    values = [math.log(1 + sum(x >= least for x in saved)) for least in (2, 3, 4, 5, 6, 7, 8)]
    values += [math.log(max(1, len(saved))), max([0, *saved]) / 8, 1.0]
    total = sum(a * b for a, b in zip(values, model.weights, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))
