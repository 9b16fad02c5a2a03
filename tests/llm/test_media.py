import hashlib
import io
import wave
import zlib

import numpy as np

from barlattice.llm import media


def test_round_trip(documents):
    texts = ["a", None, "", "é" * 96, "é" * 97, "x" * 400_000, "a", "words and words " * 500]
    docs = documents(texts, extra=", codes bigint, media bigint")
    rows = {r.doc_id: r for r in media.media_column(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        with wave.open(io.BytesIO(bytes(rows[i].media))) as w:
            assert w.readframes(w.getnframes()) == want and w.getsampwidth() == 1
        assert rows[i].n_bytes == len(raw) and rows[i].payload_bytes == len(want)
        assert rows[i].payload_sha256 == hashlib.sha256(want).hexdigest()
        assert rows[i].tail_crc32 == zlib.crc32(want[-16:])
        assert len(rows[i].codes) == len(rows[i].times) and list(rows[i].times) == sorted(rows[i].times)
    assert rows[0].codes == rows[6].codes and rows[1].codes == [] == rows[2].codes
    assert len(rows[7].codes) > 0
    out = {r.doc_id: r for r in media.digest_columns(media.media_column(docs)).collect()}
    assert out[0].feature == out[6].feature and out[0].media_sha256 == hashlib.sha256(bytes(rows[0].media)).hexdigest()


def test_fingerprints_of_a_tone():
    t = np.arange(192 * 20)
    sound = (128 + 100 * np.sin(2 * np.pi * 24 / 192 * t)).astype(np.uint8)
    at, bins = media.peaks(sound)
    first = np.unique(at, return_index=True)[1]
    assert set(bins[first]) == {24}  # the strongest peak of every frame
    code, time = media.fingerprints(sound)
    assert ((24 << 9) | (24 << 2) | 1) in code and len(code) == len(time)


def test_chunks_do_not_change_peaks(monkeypatch):
    sound = np.random.default_rng(1).integers(0, 255, 192 * 50).astype(np.uint8)
    whole = media.fingerprints(sound)
    monkeypatch.setattr(media, "CHUNK", 7)
    parts = media.fingerprints(sound)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_empty_table(documents):
    assert media.media_column(documents([])).count() == 0
