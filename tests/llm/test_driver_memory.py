"""What operators leave in the driver's memory."""

import re
from pathlib import Path

from cellwise.llm import common


def in_arenas(pid):
    """MB in mappings of 64 MB at most, which arenas are made of; the Java heap is larger."""
    sizes = re.findall(r"^(Size|Anonymous):\s+(\d+)", Path(f"/proc/{pid}/smaps").read_text(), re.M)
    found = [(int(x[1]), int(y[1])) for x, y in zip(sizes[::2], sizes[1::2], strict=True)]
    return sum(own for size, own in found if size <= 65536) / 1024


def test_native_memory_goes_back(spark):
    """What the driver's JVM has freed below something that lives goes back to the system with the next durable()."""
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    common.durable(spark.range(10)).count()
    held = [jvm.java.util.zip.Deflater() for _ in range(600)]  # a quarter of a MB each
    for d in held[:-1]:
        d.end()
    before = in_arenas(pid)
    assert common.durable(spark.range(10)).count() == 10
    after = in_arenas(pid)
    held[-1].end()
    assert before - after > 40
