"""Plain versions of structure repair, tokenizer alignment and exact search."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def best_edits(rows, faults):
    """Least (cost, audit, lines) by trying every edit before and at each row, two insertions in a row at most."""
    goes = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit, lines) in list(best.items()):
                role = "assistant" if state == "u" else "user"
                new = (cost + 5, audit + "I", [*lines, f"{role}:"])
                if role[0] not in best or new < best[role[0]]:
                    best[role[0]] = new
        return best

    best = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, lines) in best.items():
            found = [(state, (cost + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                if (state, role[:1]) in goes:
                    found.append((role[:1], (cost + late, audit + "K", [*lines, f"{role}:{text}"])))
                found += [(goes[state, r[0]], (cost + late + 1, audit + "R", [*lines, f"{r}:{text}"])) for r in ("user", "assistant") if (state, r[0]) in goes]
            for to, new in found:
                after[to] = min(after.get(to, new), new)
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def repaired(rows):
    """Per conversation: (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)."""
    kept = defaultdict(list)
    for conv, *row in damage(rows):
        kept[conv].append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(kept[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.strip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = best_edits([r[1:] for r in own], faults)
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def aligned(texts):
    """Per text: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest), from the tokenizers themselves."""
    import public_tokenizers as public
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    signs = sorted(pre_tokenizers.ByteLevel.alphabet())
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | dict(zip((chr(256 + k) for k in range(68)), (x for x in range(256) if x not in plain), strict=True))
    assert set(byte) == set(signs)

    def groups(text):
        raw = f" {text}".encode()
        ids_a, ids_b = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        of_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not text or b"".join(of_a) != raw or b"".join(of_b) != raw:
            return []
        out, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
        while i < len(of_a) or j < len(of_b):
            if at_a <= at_b and i < len(of_a):
                out[-1][0].append(ids_a[i])
                at_a, i = at_a + len(of_a[i]), i + 1
            else:
                out[-1][1].append(ids_b[j])
                at_b, j = at_b + len(of_b[j]), j + 1
            if at_a == at_b:
                out.append(([], []))
        return out[:-1]

    found = [groups(t) for t in texts]
    links = [[(x, y) for ga, gb in g for x in ga for y in gb] for g in found]
    count = Counter(p for doc in links for p in set(doc))
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    written = [";".join("|".join(",".join(map(str, side)) for side in g) for g in doc) for doc in found]
    return [
        (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(w.encode()).hexdigest() if g else "")
        for g, own, w in zip(found, links, written, strict=True)
    ]


def top_k(rows, k=5, step=50):
    """(query, rank, id, score) rows."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in whole if i is not None and i % step == 0}):
        scores = [(-sum(x * y for x, y in zip(a, v, strict=False)), i is None, i or 0) for j, a in whole if j == q for i, v in whole if i != q]
        out += [(q, rank, None if null else i, -score) for rank, (score, null, i) in enumerate(sorted(scores)[:k], 1)]
    return out
