import tracemalloc

import numpy as np

from proofsheet.llm import flac


def test_memory_of_a_long_payload_follows_its_bytes():
    payload = np.random.default_rng(0).integers(97, 123, 576 * 10_000, np.uint8).tobytes()
    flac.encode([payload[: 576 * 100]])
    tracemalloc.start()
    (stream,) = flac.encode([payload])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 60_000_000 + 4 * len(payload)
    ((info, samples),) = flac.decode([stream])
    assert (samples + 128).astype(np.uint8).tobytes() == payload and info["md5"] != bytes(16)


def test_every_stream_says_its_digest():
    for sizes in (True, False):
        (stream,) = flac.encode([b"\xff" * 576], sizes=sizes)
        ((info, _),) = flac.decode([stream])
        assert info["md5"] != bytes(16) and (stream[12:18] == bytes(6)) != sizes
        spoilt = bytearray(stream)
        spoilt[26] ^= 1  # within the digest
        assert isinstance(flac.decoded([bytes(spoilt)])[0], str)
