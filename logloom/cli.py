"""Command line: python -m logloom.cli -d tables.txt [-c "SELECT ..."] [-f] files..."""

from __future__ import annotations

import argparse
import sys

from logloom.plans.engine import Tables, compile_query
from logloom.plans.errors import LoomError
from logloom.sources.lines import ReadLinesIterator, read_lines
from logloom.sources.sinks import FORMATS, Printer


def arguments() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="logloom", description="SQL over text lines")
    a.add_argument("files", nargs="*", help="files to read, in this order")
    a.add_argument("-d", "--data-definition-file", help="file with CREATE TABLE statements")
    a.add_argument("-c", "--command", help="the SELECT to run")
    a.add_argument("--command-file", help="file with the SELECT to run")
    a.add_argument("-f", "--follow", action="store_true", help="follow the (first) file")
    a.add_argument("--head", action="store_true", help="when following, begin with what the file holds")
    a.add_argument("--stdin", action="store_true", help="read lines from standard input")
    a.add_argument("--format", choices=FORMATS, default="text")
    a.add_argument("--show-run-stats", action="store_true")
    a.add_argument("--preview", metavar="TABLE", help="show what a table makes of the first lines of the first file")
    a.add_argument("--edit-table", metavar="FILE", help="try definitions on the first lines of a file, and save them")
    return a


def run(tables: Tables, query: str, o: argparse.Namespace, println=print) -> None:
    s, printer = compile_query(query), Printer(o.format, println)
    if o.follow:
        from logloom.streaming.follow import follow_query

        follow_query(tables, s, (o.files or [s.path])[0], lambda names, types, rows: printer.rows(names, types, rows, False), head=o.head).awaitTermination()
        return
    if o.show_run_stats:
        p, rows, statistics = tables.run_with_statistics(o.files, s)
        for r in rows:
            printer.row(p.names, p.types, r)
        println(str(statistics))
        return
    p = tables.plan((line for line in sys.stdin) if o.stdin else ReadLinesIterator(*o.files), s)
    for r in p.df.toLocalIterator(prefetchPartitions=True):
        printer.row(p.names, p.types, r)


def shell(tables: Tables, o: argparse.Namespace) -> None:
    """Reads statements, each up to its semicolon; ``\\d`` lists tables, ``\\d table`` its columns, ``exit`` leaves."""
    try:
        import readline

        from logloom.plans.grammar import completion_words

        words = completion_words()
        readline.set_completer(lambda text, k: [*(w for w in words if w.startswith(text.upper())), None][k])
        readline.parse_and_bind("tab: complete")
    except ImportError:
        pass
    waiting = ""
    while True:
        try:
            part = input("... " if waiting else "> ").strip()
        except EOFError:
            return
        if not waiting and part == "exit":
            return
        try:
            if not waiting and part.startswith("\\d"):
                name = part[2:].strip()
                if name:
                    tables.describe(name).show(1000, False)
                else:
                    print("\n".join(tables.table_names()))
                continue
            waiting = f"{waiting}\n{part}".strip()
            if waiting.endswith(";"):
                query, waiting = waiting, ""
                (tables.add_table(query) if query[:6].lower() == "create" else run(tables, query, o))
        except (LoomError, OSError) as e:
            print(e, file=sys.stderr)


def edit(tables: Tables, path: str, lines: int = 1000) -> None:
    """Tries definitions on a file's first lines: each CREATE TABLE, up to its semicolon, shows at once what it makes of them.

    An empty line shows the lines as they are, ``save FILE`` adds the last definition that worked to a file, ``exit`` leaves.
    """
    head = tables.spark.createDataFrame([tuple(r) for r in read_lines(tables.spark, path).limit(lines).toLocalIterator()], "value string")
    waiting = good = ""
    while True:
        try:
            part = input("... " if waiting else "edit> ").strip()
        except EOFError:
            return
        try:
            if waiting or part[:6].lower() == "create":
                waiting = f"{waiting}\n{part}".strip()
                if waiting.endswith(";"):
                    text, waiting = waiting, ""
                    tables.add_table(text)
                    tables.preview(tables.table_names()[-1], head).show(lines, False)
                    good = text
            elif part == "exit":
                return
            elif part[:5] == "save " and good:
                with open(part[5:].strip(), "a", encoding="utf-8") as f:
                    f.write(good + "\n")
            elif not part:
                head.show(lines, False)
            else:
                print("expected CREATE TABLE, save FILE or exit", file=sys.stderr)
        except (LoomError, OSError) as e:
            print(e, file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    o = arguments().parse_args(argv)
    tables = Tables()
    try:
        if o.data_definition_file:
            with open(o.data_definition_file, encoding="utf-8") as f:
                tables.add_table(f.read())
        query = o.command
        if o.command_file:
            with open(o.command_file, encoding="utf-8") as f:
                query = f.read()
        if o.edit_table:
            edit(tables, o.edit_table)
        elif o.preview:
            tables.preview(o.preview, o.files[0]).show(1000, False)
        elif query:
            run(tables, query, o)
        else:
            shell(tables, o)
    except (LoomError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        pass
    return 0


if __name__ == "__main__":
    sys.exit(main())
