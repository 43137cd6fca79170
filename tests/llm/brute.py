"""Plain-Python versions of the operators, to hold them against."""

from __future__ import annotations

import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str | None, size: int = 5) -> set:
    w = words(lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def roots(nodes, links) -> dict:
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(rows: list[tuple[int, str | None]], percent: int, size: int = 5) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, size) for i, t in rows}
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    both: dict = {}
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                both[a, b] = both.get((a, b), 0) + 1
    links = [p for p, n in both.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    root = roots(sets, links)
    return {i: (len(sets[i]), root[i]) for i in sets}


def quality(text: str | None) -> dict:
    t, w = text or "", words(text)

    def covered(size: int) -> int:
        at: dict = {}
        for i in range(len(w) - size + 1):
            at.setdefault(tuple(w[i : i + size]), []).append(i)
        return len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + size)})

    longest = 0
    while covered(longest + 1):
        longest += 1
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n_repeat = covered(8)
    failed = len(w) < 20 or 100 * n_repeat > 30 * len(w)
    n_covered = covered(4)
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(t.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": again,
        "n_repeat_words": n_repeat,
        "n_covered": n_covered,
        "longest_repeat": longest,
        "base_failed": failed,
        "kept": not failed and n_covered <= 0.4 * len(w) and longest <= 60,
    }


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def remove_repeats(rows: list[tuple[int | None, str | None]], size: int = 13) -> list[tuple]:
    owner: dict = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[k : k + size])
            owner[key] = min(owner.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1) if i is not None else ():
            if owner[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def alignment(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, group text; token by token."""
    from collections import Counter

    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    decode = {}
    for byte in range(256):  # a single byte is encoded as its own entry
        plain = 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174
        decode[chr(byte) if plain else chr(256 + len([c for c in decode if ord(c) > 255]))] = byte

    def spans(tokens: list[bytes]) -> list[tuple[int, int]]:
        out, at = [], 0
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    def piece(i: int) -> bytes:
        p = b.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()

    found, pairs = [], Counter()
    for id, text in rows:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ta = [bytes(decode[c] for c in a.id_to_token(i)) for i in ia]
        tb = [piece(i) for i in ib]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(ta) != whole or b"".join(tb) != whole:
            ia, ib, ta, tb = [], [], [], []
        sa, sb = spans(ta), spans(tb)
        links, j = [], 0
        for i, (s, e) in enumerate(sa):
            while j and sb[j][0] > s:
                j -= 1
            while sb[j][1] <= s:
                j += 1
            while j < len(sb) and sb[j][0] < e:
                links.append((ia[i], ib[j]))
                j += 1
            j -= 1
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, s = [], 0
        for e in ends:
            groups.append((s, e))
            s = e
        names, pa, pb = [], 0, 0
        for _, e in groups:
            one, two = [], []
            while pa < len(sa) and sa[pa][1] <= e:
                one.append(str(ia[pa]))
                pa += 1
            while pb < len(sb) and sb[pb][1] <= e:
                two.append(str(ib[pb]))
                pb += 1
            names.append(",".join(one) + "|" + ",".join(two))
        pairs.update(links)
        found.append((id, len(ia), len(ib), len(groups), links, ";".join(names)))
    most: Counter = Counter()
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return [
        (id, na, nb, ng, len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links), names)
        for id, na, nb, ng, links, names in found
    ]


def parity_words(n: int = 10) -> tuple[str, str]:
    """Two words of 2**n letters, the parity sequence and its complement: equal under any polynomial modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
