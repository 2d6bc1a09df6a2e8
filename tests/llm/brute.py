"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def decontaminated(docs, items):
    """{doc row: (n_words, n_hit, items)} for docs [(doc_id, text)] and items [(item_id, text)]."""
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall((text or "").translate(ASCII))
        for s in range(max(1, len(words) - 9)) if words else ():
            windows[tuple(words[s : s + 10])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = WORD.findall((text or "").translate(ASCII))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(words) - n + 1):
                items_of = windows.get(tuple(words[s : s + n]))
                if items_of:
                    hit.update(range(s, s + n))
                    found |= items_of
        ids = sorted(map(str, found))
        out.append((doc, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def base_spans(text):
    text = text or ""
    found = []
    for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def shingles(text, size):
    words = PLAIN_WORD.findall((text or "").translate(ASCII))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(docs, size, percent):
    """[(doc_id, set size, smallest reachable doc_id)]."""
    sets = [(d, shingles(t, size)) for d, t in docs]
    nodes = {}
    for d, s in sets:
        if s:
            nodes.setdefault(s, []).append(d)
    parent = {s: s for s in nodes}

    def top(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for a, b in combinations(nodes, 2):
        if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                parent[top(a)] = top(b)
    low = {}
    for s, ids in nodes.items():
        low[top(s)] = min(low.get(top(s), ids[0]), *ids)
    return [(d, len(s), low[top(s)] if s else d) for d, s in sets]


def quality(text):
    text = text or ""
    words = PLAIN_WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if PLAIN_WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def token_ids(texts, name, end_id):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*e.ids, end_id] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def perspectives(turns):
    """Rows (conv, perspective, turn, role, name, segment, start, end, loss_start, loss_end) of [(conv, turn, role, text)]."""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn if turn is not None else float("-inf"), "unknown" if role is None else role, text or "", turn))
    out = []
    for conv, rows in by.items():
        for who in {r[1] for r in rows} - {"system"}:
            at = 0
            for _, speaker, body, turn in sorted(rows, key=lambda r: r[:3]):
                role = "system" if speaker == "system" else "assistant" if speaker == who else "user"
                name = speaker if role == "user" else None
                head = f"<|im_start|>{role}" + (f" name={name}" if name else "") + "\n"
                segment = head + body + "<|im_end|>\n"
                own = role == "assistant"
                end = at + len(segment)
                out.append((conv, who, turn, role, name, segment, at, end, at + len(head) if own else -1, end - 1 if own else -1))
                at = end
    return out


def periodic_runs(words):
    """Sorted (start, length, period) of all runs: stretches of smallest period q and at least max(6, 4 * q) words."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def run_digest(doc_id, text):
    words = looped(doc_id, PLAIN_WORD.findall(text or ""))
    runs = periodic_runs(words)
    lost = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in lost)))


class Interpolated:
    """The interpolated n-gram model with plain dictionaries: counts, weights by as many rounds as it takes, and scores."""

    BEGIN, END = ("begin",), ("end",)

    def __init__(self, docs, order):
        self.order, self.sizes = order, {}
        texts = [(d, self.fold(d), [*PLAIN_WORD.findall((t or "").translate(ASCII)), self.END]) for d, t in docs]
        self.part = self.counted([w for _, f, w in texts if f not in (0, 1)])
        self.all = self.counted([w for _, f, w in texts if f])
        self.tuning = [w for _, f, w in texts if f == 1]
        self.weights, self.course = defaultdict(lambda: 0.5), []
        self.tune()
        n, v = self.all[1][()], self.single(self.all)
        self.rows = []
        for d, f, words in texts:
            single = [self.all[0].get((w,), 0) for w in words]
            base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in single)
            score = sum(math.log10(self.levels(self.all, h, w)[-1][0]) for h, w in self.events(words))
            self.rows.append((d, f == 0, len(words), sum(c > 0 for c in single), n, base, score))

    @staticmethod
    def fold(d):
        return 0 if d is None else zlib.crc32(str(d).encode()) % 10

    def events(self, words):
        stream = [self.BEGIN] * (self.order - 1) + words
        return [(tuple(stream[i : i + self.order - 1]), w) for i, w in enumerate(words)]

    def counted(self, texts):
        grams, contexts = Counter(), Counter()
        for words in texts:
            for h, w in self.events(words):
                for k in range(self.order):
                    c = h[len(h) - k :]
                    grams[(*c, w)] += 1
                    contexts[c] += 1
        return grams, contexts

    def levels(self, counts, h, w):
        """[(chance, class, share of this level's own estimate)] from the lowest order up."""
        grams, contexts = counts
        p, out = 1 / (self.single(counts) + 1), []
        for k in range(self.order):
            c = h[len(h) - k :]
            n = contexts.get(c, 0)
            own = self.weights[k, n.bit_length()] * grams.get((*c, w), 0) / n if n else 0
            whole = own + (1 - self.weights[k, n.bit_length()] if n else 1) * p
            out.append((whole, (k, n.bit_length()), own / whole))
            p = whole
        return out

    def single(self, counts):
        if id(counts) not in self.sizes:
            self.sizes[id(counts)] = sum(len(g) == 1 for g in counts[0])
        return self.sizes[id(counts)]

    def tune(self):
        for _ in range(30):
            used, tried, gain, n = Counter(), Counter(), 0.0, 0
            for words in self.tuning:
                for h, w in self.events(words):
                    levels, reach = self.levels(self.part, h, w), 1.0
                    gain, n = gain + math.log(levels[-1][0]), n + 1
                    for _, place, share in reversed(levels):
                        used[place] += reach * share
                        tried[place] += reach
                        reach *= 1 - share
            if not n:
                return
            self.course.append(gain / n)
            self.weights = defaultdict(lambda: 0.5)
            for k in range(self.order):
                for c in range(1, 65):
                    self.weights[k, c] = (used[k, c] + 0.5) / (tried[k, c] + 1) if (k, c) in tried else self.weights[k, c - 1]
            if len(self.course) > 1 and self.course[-1] - self.course[-2] < 1e-6 * abs(self.course[-2]):
                return


def line_rules(rows):
    """[(doc_id, kept, words removed)] for rows (doc_id, text, host): lines that too many documents of a host hold are removed."""
    keys, documents, holders = [], defaultdict(set), defaultdict(set)
    for d, text, host in rows:
        lines = [(" ".join(PLAIN_WORD.findall(x)).translate(ASCII).translate(str.maketrans("0123456789", "0" * 10)), len(PLAIN_WORD.findall(x))) for x in (text or "").split("\n") if PLAIN_WORD.search(x)]
        keys.append((d, text, host, lines))
        documents[host].add((d, text))
        for line, _ in lines:
            holders[host, line].add((d, text))
    out = []
    for d, text, host, lines in keys:
        n = len(documents[host])
        most = max(2, math.floor(n * 0.1 + 1.645 * math.sqrt(n * 0.1 * 0.9)))
        removed = sum(w for line, w in lines if len(holders[host, line]) > most)
        words = sum(w for _, w in lines)
        out.append((d, not quality(text)[5] and removed <= 0.5 * words, removed))
    return out
