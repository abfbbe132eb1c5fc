"""Files new, known, removed and back, suppressed: as state of a stream over listings."""

import time

from quillspark.streaming import listings


def test_names_as_state(spark, tmp_path):
    inbox, log, out = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "out")
    inbox.mkdir()
    put = lambda n: (inbox / n).write_bytes(b"x")
    put("there.pdf")
    listings.post(spark, str(inbox), log)
    seen = []

    def poll():
        """A listing and what the stream gives for it; each run goes on from the checkpoint."""
        listings.post(spark, str(inbox), log)
        listings.fresh(spark, log).writeStream.foreachBatch(lambda d, _: seen.extend(r["name"] for r in d.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start().awaitTermination(120)
        found = sorted(seen)
        seen.clear()
        return found

    put("a.pdf"), put("note.txt")
    assert poll() == ["a.pdf"]  # what was there at the first listing isn't new
    (inbox / "a.pdf").unlink()
    put("b.png")
    assert poll() == ["b.png"]
    put("a.pdf")
    listings.suppress(spark, log, "c.pdf", 6)
    assert poll() == ["a.pdf"]  # put back: new again
    put("c.pdf"), put("d.pdf")
    assert poll() == ["d.pdf"]
    (inbox / "c.pdf").unlink()
    time.sleep(6)
    assert poll() == []
    put("c.pdf")
    assert poll() == ["c.pdf"]  # suppression is over by itself
