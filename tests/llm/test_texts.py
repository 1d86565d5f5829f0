"""Media columns, token counts, packing, licenses: exact round trips and library results on awkward rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import ROWS, documents, ids

from crownlake.llm import progressive_jpeg as J
from crownlake.llm.license_templates import TEMPLATES, compile_template, license_digest, scan_licenses, words_of
from crownlake.llm.media_columns import decode_media, encode_media, media_digest, padded
from crownlake.llm.packing import ChunkIds, best_fit, pack, plan_of, reduce_by_dominance, token_pieces
from crownlake.llm.queries import tokenizer_file
from crownlake.llm.token_counts import SAME_CLASSES, PreTokens, count_tokens

TEXTS = [t or "" for _, t in ROWS]


# ---- JPEG -------------------------------------------------------------------------------------------


def bits_of(value: int, size: int) -> str:
    return f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else ""


def code(table: J.Huffman, symbol: int) -> str:
    at, n = table.code[symbol]
    return f"{at:0{n}b}"


def written(text: str) -> bytes:
    text += "1" * (-len(text) % 8)
    return (int(text, 2).to_bytes(len(text) // 8) if text else b"").replace(b"\xff", b"\xff\x00")


def general_jpeg(coefs: list[np.ndarray], sampling: list[tuple[int, int]], width: int, height: int, restart: int = 0) -> bytes:
    """A plain progressive writer, coefficient by coefficient, for any values: the decoder's counterpart."""
    lengths = {s: 8 for s in range(255)}
    head, symbols = J._table(1, 0, lengths), bytes(sorted(lengths))
    table = J.Huffman.build([0] * 7 + [255] + [0] * 8, symbols)
    dc = J.Huffman.build([0] * 3 + [12] + [0] * 12, bytes(range(12)))
    out = [b"\xff\xd8", J._marker(0xDB, b"\x00" + bytes([2]) * 64)]
    out += [J._marker(0xC2, struct.pack(">BHHB", 8, height, width, len(coefs)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling)))]
    out += [head, J._table(0, 0, {s: 4 for s in range(12)})]
    if restart:
        out.append(J._marker(0xDD, struct.pack(">H", restart)))
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))

    def in_pieces(units, make):
        step = restart or len(units)
        parts = [make(units[a : a + step]) for a in range(0, len(units), step)]
        return b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(parts) else b"") for k, p in enumerate(parts))

    mcus = [[(o, (m // across * v + y) * across * h + m % across * h + x) for o, (h, v) in enumerate(sampling) for y in range(v) for x in range(h)] for m in range(across * down)]
    for low in (1, 0):
        def dc_scan(units, low=low):
            text, last = "", [0] * len(coefs)
            for unit in units:
                for o, b in unit:
                    value = int(coefs[o][b, 0]) >> low
                    if low:
                        d = value - last[o]
                        last[o] = value
                        size = abs(d).bit_length()
                        text += code(dc, size) + bits_of(d, size)
                    else:
                        text += str(value & 1)
            return written(text)

        every = list(range(1, len(coefs) + 1))
        if len(coefs) > 1:
            out += [J._start(every, 0, 0, 0, 0 if low else 1, low), in_pieces(mcus, dc_scan)]
        else:
            blocks = [[(0, b)] for b in range(len(coefs[0]))]
            out += [J._start(every, 0, 0, 0, 0 if low else 1, low), in_pieces(blocks, dc_scan)]
    for o, (h, v) in enumerate(sampling):
        wide, high = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
        blocks = [r * across * h + c for r in range(high) for c in range(wide)]
        for first, last in ((1, 5), (6, 63)):
            def ac_first(units, o=o, first=first, last=last):
                text, empty = "", 0
                def flush():
                    nonlocal text, empty
                    while empty:
                        r = min(14, empty.bit_length() - 1)
                        n = min(empty, (1 << (r + 1)) - 1)
                        text += code(table, r << 4) + (f"{n - (1 << r):0{r}b}" if r else "")
                        empty -= n
                for b in units:
                    run = 0
                    values = [int(np.sign(x)) * (abs(int(x)) >> 1) for x in coefs[o][b, first : last + 1]]
                    top = max((k for k, x in enumerate(values) if x), default=-1)
                    for k in range(top + 1):
                        if not values[k]:
                            run += 1
                            continue
                        flush()
                        while run > 15:
                            text += code(table, 0xF0)
                            run -= 16
                        size = abs(values[k]).bit_length()
                        text += code(table, run << 4 | size) + bits_of(values[k], size)
                        run = 0
                    if top + 1 < len(values):
                        empty += 1
                        if empty == 32767:
                            flush()
                flush()
                return written(text)
            out += [J._start([o + 1], 0, first, last, 0, 1), in_pieces(blocks, ac_first)]

        def ac_refine(units, o=o):
            text, empty, kept = "", 0, ""
            def flush():
                nonlocal text, empty, kept
                if empty:
                    r = empty.bit_length() - 1
                    text += code(table, r << 4) + (f"{empty - (1 << r):0{r}b}" if r else "") + kept
                    empty, kept = 0, ""
            for b in units:
                values = [int(x) for x in coefs[o][b, 1:]]
                top = max((k for k, x in enumerate(values) if abs(x) == 1), default=-1)
                run, held = 0, ""
                for k, x in enumerate(values):
                    if k > top:
                        held += str(abs(x) & 1) if abs(x) > 1 else ""
                    elif abs(x) > 1:
                        held += str(abs(x) & 1)
                    elif x == 0:
                        if run == 15:
                            flush()
                            text, run, held = text + code(table, 0xF0) + held, 0, ""
                            continue
                        run += 1
                    else:
                        flush()
                        text, run, held = text + code(table, run << 4 | 1) + ("1" if x > 0 else "0") + held, 0, ""
                if top < 62:
                    empty, kept = empty + 1, kept + held
            flush()
            return written(text)
        out += [J._start([o + 1], 0, 1, 63, 1, 0), in_pieces(blocks, ac_refine)]
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("density", [0.02, 0.3, 1.0])
def test_decoder_reads_any_coefficients(sampling, restart, density):
    rng = np.random.default_rng(int(density * 100) + restart)
    width, height = 61, 43
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    coefs = []
    for h, v in sampling:
        x = rng.integers(-40, 41, (across * h * down * v, 64)) * (rng.random((across * h * down * v, 64)) < density)
        wide, high = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
        place = np.arange(len(x))
        x[(place % (across * h) >= wide) | (place // (across * h) >= high), 1:] = 0  # blocks that only DC scans hold
        coefs.append(x)
    data = general_jpeg(coefs, sampling, width, height, restart)
    picture = J.decode(data)
    for c, x in zip(picture.components, coefs, strict=True):
        assert np.array_equal(c.coef, x)
    rgb = picture.rgb()
    assert rgb.shape == (height, width, 3) and rgb.dtype == np.uint8
    # the inverse transform against its formula, on one block of the first component
    u = np.zeros(64)
    u[J.ZIGZAG] = coefs[0][0] * 2
    k = np.arange(8)
    basis = np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
    block = np.clip(np.round(basis.T @ u.reshape(8, 8) @ basis + 128), 0, 255)
    plane = picture.planes()[0]
    assert np.abs(plane[:8, :8].astype(int) - block).max() <= 1


def test_zigzag_order():
    assert J.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(J.ZIGZAG) == list(range(64))


def test_broken_files_raise():
    good = J.encode_payload(b" " * 384)
    for bad in (b"", b"\xff\xd8", good[: len(good) // 2], good[2:]):
        with pytest.raises(J.JpegError):
            J.decode(bad)


def test_media_round_trip(spark):
    docs = documents(spark)
    media = encode_media(docs)
    got = media_digest(media).collect()
    assert ids(got) == ids(ROWS)
    expected = Counter()
    for key, text in ROWS:
        raw = (text or "").encode()
        p = padded(raw)
        expected[(key, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == expected
    tensors = decode_media(media).collect()
    assert all(len(r.rgb) == r.width * r.height * 3 and r.error is None for r in tensors)
    bad = spark.createDataFrame([(1, b"nope"), (2, None)], "doc_id long, media binary")
    assert [r.rgb for r in decode_media(bad).collect()] == [None, None]
    assert media_digest(encode_media(docs.filter("false"))).count() == 0


# ---- tokens -----------------------------------------------------------------------------------------


def test_counts_are_the_librarys(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    own = PreTokens(path)
    for head in (1 << 18, 3):  # nearly all by broadcast, nearly all by join
        got = count_tokens(documents(spark), path, head=head).collect()
        expected = Counter((k, len((t or "").encode()), len(own.tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t in ROWS)
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert count_tokens(documents(spark, []), path).count() == 0


def test_character_classes_are_the_librarys():
    own = PreTokens(tokenizer_file("byte_bpe_50k.json"))
    same = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not SAME_CLASSES.search(chr(c))]
    for a in range(0, len(same), 997):
        text = "a".join(same[a : a + 997]) + " 1" + " ".join(same[a : a + 997])
        assert own.pattern.findall(text) == [text[x:y] for _, (x, y) in own.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_chunk_ids_are_the_librarys():
    own = ChunkIds(tokenizer_file("word_bpe_49k.json"))
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZéèüßñÀ.,!?'-_;:()[]{}#$%&*+/=@^`|~<>0123456789"
    texts = TEXTS + [" ".join("".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(60)) for _ in range(150)]
    assert own.ids(texts) == own._encoded(texts)


def test_pieces_and_places(spark):
    path = tokenizer_file("word_bpe_49k.json")
    own = ChunkIds(path)
    got = pack(token_pieces(documents(spark), path, capacity=64), capacity=64).collect()
    whole = {}
    for key, text in ROWS:
        whole.setdefault(key, own._encoded([text or ""])[0] + bytes(4))
    for r in got:
        part = whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert zlib.crc32(part) == r.ids_crc32 and r.start == 64 * r.piece and 0 < r.length <= 64
    assert sum(r.length for r in got) == sum(len(own._encoded([t or ""])[0]) // 4 + 1 for _, t in ROWS)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert pack(token_pieces(documents(spark, []), path)).count() == 0


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room + items[k] <= capacity:
                at = bins.index(room)
                bins[at] += items[k]
                place(k + 1, bins)
                bins[at] -= items[k]
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(250):
        capacity = rng.choice([10, 20, 30])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 9)))
        fixed, left = reduce_by_dominance(counts, capacity)
        spread = [k for k, n in left.items() for _ in range(n)]
        assert sum(m for _, m in fixed) + fewest(spread, capacity) == fewest(list(counts.elements()), capacity)
        plan = plan_of(counts, capacity)
        assert Counter(x for p, m in plan for x in p for _ in range(m)) == counts and all(sum(p) <= capacity for p, _ in plan)


def test_best_fit_equals_one_by_one():
    rng = random.Random(2)
    for _ in range(100):
        counts = Counter(rng.randint(1, 40) for _ in range(60))
        bins = []
        for x in sorted(counts.elements(), reverse=True):
            fit = [k for k, b in enumerate(bins) if b + x <= 50]
            if fit:
                bins[max(fit, key=lambda k: bins[k])] += x
            else:
                bins.append(x)
        assert sum(m for _, m in best_fit(counts, 50)) == len(bins)


# ---- licenses ---------------------------------------------------------------------------------------


def test_template_regions():
    a = compile_template("x", "granted to <<1-3>> under [[the terms of]] the license")
    ok = ["granted to bob under the license", "granted to bob and ann under the terms of the license"]
    bad = ["granted to under the license", "granted to a b c d under the license", "granted to bob under the terms the license", "granted to bob beneath the license"]
    assert all(a.accepts_at(words_of(t), 0) == len(t.split()) for t in ok)
    assert all(a.accepts_at(words_of(t), 0) is None for t in bad)
    with pytest.raises(ValueError):
        compile_template("x", "[[maybe]] this")


def test_license_digest_equals_brute_force(spark):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    rng = random.Random(4)
    parts = [*phrases, "MIT", "license", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "cc", "by", "é", "x1", "permission is hereby granted"]
    rows = ROWS + [(100 + k, rng.choice(["; ", " ", "\n"]).join(rng.choices(parts, k=rng.randint(0, 30)))) for k in range(60)]
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_digest(documents(spark, rows)).collect()}
    expected = set()
    for key, text in rows:
        words = words_of(text or "")
        found = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.encode().split()]
        at = [k for k, _ in found]
        expected.add((key, len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    assert got == expected
    row = license_digest(documents(spark, [(1, "Licensed under the Apache License, Version 2.0, see there")])).first()
    assert row.labels == "apache,apache-2.0" and row.score == 1.0
    assert scan_licenses(documents(spark, [])).count() == 0


MIT = """Copyright (c) 2020 Ann. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_licenses_need_every_mandatory_word(spark):
    rows = [(1, MIT), (2, MIT.replace("merge", "fold")), (3, MIT[: MIT.index("THE SOFTWARE IS")]), (4, MIT.replace("Software", "Font Tools").replace("THE SOFTWARE", "THE FONT TOOLS"))]
    got = {r.doc_id: [m.label for m in r.matches] for r in scan_licenses(documents(spark, rows)).collect()}
    assert got == {1: ["mit"], 2: [], 3: [], 4: ["mit"]}


@pytest.mark.parametrize("label, markup", TEMPLATES)
def test_templates_accept_their_wording_and_nothing_else(label, markup):
    a, parts = compile_template(label, markup), [p for p in re.split(r"(\[\[.*?\]\]|<<\d+-\d+>>)", markup) if p.strip()]
    for longest in (False, True):
        words, fixed = [], []
        for p in parts:
            if p.startswith("<<"):
                words += [b"filler"] * int(p[2:-2].split("-")[longest])
            elif not p.startswith("[[") or longest:
                fixed += range(len(words), len(words) + len(words_of(p))) if not p.startswith("[[") else []
                words += words_of(p)
        assert a.accepts_at(words, 0) == len(words)
        if not longest:
            for k in fixed:
                assert a.accepts_at([*words[:k], b"changed", *words[k + 1 :]], 0) is None
                assert a.accepts_at([*words[:k], b"changed", *words[k:]], 0) is None or k == 0 or any(words[j] == b"filler" for j in (k - 1, k))
