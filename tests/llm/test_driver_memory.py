"""What the driver's JVM frees outside its heap goes back to the system between steps."""

import re
from pathlib import Path

from korvex.llm.common import Workspace


def test_tidy_returns_native_memory(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    kept = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024
    ws = Workspace(spark, "memory")
    ws.tidy()
    deflaters = [jvm.java.util.zip.Deflater() for _ in range(1200)]  # some 256 kB of native memory each
    for d in deflaters:
        d.setInput(bytearray(b"abcd" * 20_000))
        d.finish()
        d.deflate(bytearray(9000))
    full = kept()
    for i, d in enumerate(deflaters):
        if i % 40:  # those that stay hold the ends of the areas
            d.end()
    freed = kept()
    ws.tidy()
    assert kept() < freed - 100 and kept() < full - 100
    for d in deflaters[::40]:
        d.end()
