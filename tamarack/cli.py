"""``python -m tamarack.cli``: statements end with a semicolon; .tables, .threads N, .quit."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import SparkSession

from tamarack.errors import ExecutionError, TamarackError
from tamarack.plans.render import show_table
from tamarack.plans.session import Session

PROMPT, MORE = "tamarack> ", "     ...> "


def run(session: Session, source: TextIO, out: TextIO, prompt: bool = False) -> None:
    """Reads until the end or .quit; errors are printed and the loop goes on."""
    text = ""
    say = lambda x, end="\n": print(x, end=end, file=out, flush=True)
    while True:
        if prompt:
            say(MORE if text else PROMPT, "")
        line = source.readline()
        if not line:
            return
        word = line.strip()
        if not text and word.startswith("."):
            command, *args = word.split()
            if command in (".quit", ".exit"):
                return
            if command == ".tables":
                say("\n".join(session.tables()))
            elif command == ".threads" and len(args) == 1 and args[0].isdigit() and int(args[0]) >= 1:
                session.spark.conf.set("spark.sql.shuffle.partitions", args[0])
                say(f"{args[0]} tasks after a shuffle")
            else:
                say("commands: .tables, .threads N, .quit")
            continue
        text += line
        if ";" not in text:
            continue
        sql, text = text[: text.index(";")], ""
        if not sql.strip():
            continue
        try:
            df = session.query(sql)
            say(show_table(df.columns, df.collect()))
        except TamarackError as e:
            say(f"{type(e).__name__}: {e}")
        except Exception as e:
            say(f"{ExecutionError.__name__}: {e}")


if __name__ == "__main__":
    spark = SparkSession.builder.appName("tamarack").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run(Session(spark), sys.stdin, sys.stdout, sys.stdin.isatty())
