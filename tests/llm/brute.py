"""Plain versions of the operators, written without looking at how they work."""

import hashlib
import re
from collections import Counter

import xxhash

SPACES = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def exact_groups(rows):
    """{position: (keep_id, size, is the best)} of rows (id, text)."""
    groups = {}
    for i, (id_, text) in enumerate(rows):
        groups.setdefault(SPACES.sub("", text or ""), []).append(i)
    out = {}
    for norm, members in groups.items():
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        for i in members:
            out[i] = (rows[best][0], len(members), hashlib.sha256(norm.encode()).hexdigest())
    return out


def fingerprint(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=3):
    """Root position of each fingerprint by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def statistics(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines, dups, earlier = text.split("\n"), 0, set()
    for line in lines:
        if WORDS.search(line) and line in earlier:
            dups += 1
        earlier.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside)


def page_points(root, levels):
    """{id(node): (points without a bonus, with it)} of a parsed page by the definition, an element and an ancestor at a time."""
    import html

    bonus = {"article": 25, "main": 15, "div": 5, "section": 3, "td": 3, "blockquote": 3}
    blocks = set(
        "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
        "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
    )
    heads = {"h1", "h2", "h3", "h4", "h5", "h6"}

    def size(node, links_only=False, inside=False):
        inside = inside or node.tag == "a"
        total = 0
        for c in node.children:
            if isinstance(c, str):
                total += sum(map(len, c.split())) * (inside or not links_only)
            elif not c.dropped:
                total += size(c, links_only, inside)
        return total

    def own(node):
        return "".join(c if isinstance(c, str) else "" if c.dropped or c.tag in blocks else own(c) for c in node.children)

    def every(node):
        yield node
        for c in node.children:
            if not isinstance(c, str):
                yield from every(c)

    points = {}
    for node in every(root):
        if node.dropped or node.tag not in blocks - heads:
            continue
        text, whole = " ".join(html.unescape(own(node)).split()), size(node)
        if len(text) < 25 or whole and size(node, True) > 0.8 * whole:
            continue
        worth = 1 + sum(text.count(c) for c in ",，、") + min(len(text) / 100, 3)
        to = node.parent if node.tag in ("p", "pre", "blockquote", "td", "dd", "li") else node
        share = [1, 1 / 2] + [1 / (3 * k) for k in range(2, levels)]
        for part in share:
            if to is None or to.tag == "#root":
                break
            points[id(to)] = points.get(id(to), 0) + worth * part
            to = to.parent
    out = {}
    for node in every(root):
        if id(node) in points and size(node):
            left = 1 - size(node, True) / size(node)
            out[id(node)] = (points[id(node)] * left, (points[id(node)] + bonus.get(node.tag, 0)) * left)
    return out
