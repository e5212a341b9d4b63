"""Small sources of our own that queries over syntax trees run on: the tables hold no code."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.chunking import chunk

SHOP = textwrap.dedent(
    '''\
    """A shop."""
    import subprocess as sp
    from os import system as go

    LIMIT = 3


    @app.route("/order")
    @logged
    def order(item, mode):
        note = describe(item)
        if mode == "admin":
            run(note)
        run_safe(quote(item))


    def describe(item):
        text = "item " + item
        return text


    def run(cmd):
        sp.run(cmd)


    def run_safe(cmd):
        pass


    class Basket(Base):
        size = 0

        @property
        def total(self):
            def inner():
                return 1
            return inner()

        def put(self, thing):
            self.kept = thing

        def flush(self):
            go(self.kept)
    '''
)
TOOL = textwrap.dedent(
    '''\
    def run(cmd):
        return cmd


    def main(argv):
        run(argv)
        missing(argv)
    '''
)
BROKEN = "def half(:\n    eval(x)\n\ndef other(y)\n    half(y)\n"
PING = textwrap.dedent(
    """\
    #include <stdlib.h>

    static void ping(const char *host) {
      char line[64];
      system(line);
    }

    int main(int argc, char **argv) {
      if (argc > 1) {
        ping(argv[1]);
      }
      return 0;
    }
    """
)

FILES = [("app/shop.py", "python", SHOP), ("app/tool.py", "python", TOOL), ("old/broken.py", "python", BROKEN), ("src/ping.c", "c", PING)]


def sources(spark: SparkSession) -> DataFrame:
    """(file, language, code)."""
    return spark.createDataFrame(FILES, "file string, language string, code string")


def chunks(spark: SparkSession) -> DataFrame:
    return chunk(sources(spark))


def patterns(spark: SparkSession) -> DataFrame:
    """(language, entry_patterns, sink_patterns) of the samples' languages."""
    return spark.createDataFrame(
        [("python", ["@app.route", "def main"], ["os.system", "subprocess", "eval("]), ("c", ["int main"], ["system("])],
        "language string, entry_patterns array<string>, sink_patterns array<string>",
    )
