"""What executors run is shipped with the job: it loads where the library can't be imported."""

import subprocess
import sys

import numpy as np
from pyspark import cloudpickle

from plainspeak.llm import collocations, language, mixing, neighbours, packing, page_text, pii, prefix_trie, quality, repeats, simhash  # noqa: F401

LOAD = "import sys; from pyspark import cloudpickle; f = cloudpickle.loads(sys.stdin.buffer.read()); assert callable(f)"


def test_functions_load_without_the_library():
    functions = [
        language._evidence(["en"], np.zeros((language.BUCKETS, 1))), page_text._analysed, packing._pieces(1024, None, False),
        simhash._fingerprints(4, None), simhash._links(4), pii._search, repeats._read, repeats._met, repeats._removed(20),
        repeats._leaves, prefix_trie._split_pieces, prefix_trie._digests("conv"), prefix_trie._lists, collocations._sampled,
        collocations._counted(None, True), collocations._places,
    ]

    def run_all():
        return functions

    done = subprocess.run([sys.executable, "-c", LOAD], input=cloudpickle.dumps(run_all), cwd="/", env={"PATH": "/usr/bin:/bin"}, capture_output=True)
    assert done.returncode == 0, done.stderr[-2000:]
