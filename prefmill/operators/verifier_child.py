"""Runs verifier sources in a process of its own (standard library only).

The parent writes one request per instance and reads back one byte per step.
Verdicts must depend on the instance alone, not on which instances shared a process
with it, so an instance is served by a fork unless all its verifiers are *plain*: made only of
parts on a short list of harmless ones. Plain ones, the common case, run in this process and
save the fork.

This isolates crashes and endless loops. It is no security boundary.
"""

import ast
import builtins
import collections
import datetime
import gc
import importlib.util
import json
import marshal
import os
import re
import resource
import signal
import struct
import sys
import time

EQ_TRUE, EQ_FALSE, TRUTHY, ERROR, TIMEOUT = 1, 2, 4, 8, 16
COMPILED, BROKEN, DONE = 32, 64, 128
FLUSH_SECONDS = 0.05

# What a plain verifier may use. Everything else is served by a fork.
MEMBERS = {
    "json": "loads dumps JSONDecodeError",
    "re": "match search fullmatch findall finditer split sub subn compile escape IGNORECASE I MULTILINE M "
    "DOTALL S UNICODE U VERBOSE X ASCII A",
    "math": "ceil floor sqrt log log2 log10 exp pow fabs gcd isclose isfinite isinf isnan prod trunc pi e inf nan",
    "string": "ascii_letters ascii_lowercase ascii_uppercase digits hexdigits octdigits punctuation whitespace printable",
    "collections": "Counter OrderedDict defaultdict deque",
    "itertools": "accumulate chain combinations combinations_with_replacement compress count cycle dropwhile "
    "filterfalse groupby islice permutations product repeat starmap takewhile tee zip_longest",
    "datetime": "date datetime time timedelta timezone",
    "unicodedata": "bidirectional category combining decimal digit east_asian_width is_normalized name "
    "normalize numeric",
}
MEMBERS = {module: frozenset(names.split()) for module, names in MEMBERS.items()}
BUILTINS = frozenset(
    "BaseException KeyboardInterrupt SystemExit abs all any ascii bin bool bytes callable chr complex dict divmod enumerate filter float format "
    "frozenset hash hex int isinstance iter len list map max min next oct ord pow print range repr "
    "reversed round set slice sorted str sum tuple zip ArithmeticError AttributeError Exception "
    "IndexError KeyError LookupError NameError OverflowError RuntimeError StopIteration TypeError "
    "UnicodeError ValueError ZeroDivisionError json".split()
)
# Names of annotations only: they are not used otherwise.
ANNOTATIONS = frozenset("Any Dict FrozenSet Iterable Iterator List Optional Sequence Set Tuple Union".split())
# Methods of plain values: a verifier can only change values that it made itself.
METHODS = frozenset(
    name
    for kind in (
        str, bytes, int, float, complex, tuple, list, dict, set, frozenset, range, re.Pattern, re.Match,
        collections.Counter, collections.deque, collections.OrderedDict, collections.defaultdict,
        datetime.datetime, datetime.timedelta, datetime.timezone,
    )
    for name in dir(kind) if not name.startswith("_")
) | {"msg", "doc", "pos", "lineno", "colno", "args"}
STATEMENTS = (
    ast.FunctionDef, ast.Return, ast.Assign, ast.AugAssign, ast.AnnAssign, ast.For, ast.While, ast.If,
    ast.Try, ast.Raise, ast.Assert, ast.Expr, ast.Pass, ast.Break, ast.Continue, ast.Import, ast.ImportFrom,
    ast.Delete,
)


def is_plain(tree):
    """Whether a parsed verifier only does what is known to leave nothing behind.

    It may use the statements above, names that it binds itself, the listed builtins and members
    of modules, and attributes that are methods of plain values. Annotations may
    not be strings, which could be evaluated later. What is not listed is not plain, harmless or not.
    """
    modules, bound, hints, annotations = {"json": "json"}, set(), set(), []
    nodes = list(ast.walk(tree))
    for node in nodes:
        if isinstance(node, ast.stmt) and not isinstance(node, STATEMENTS):
            return False
        if isinstance(node, ast.Import):
            for alias in node.names:
                if alias.name == "typing":
                    hints.add(alias.asname or alias.name)
                elif alias.name in MEMBERS:
                    modules[alias.asname or alias.name] = alias.name
                else:
                    return False
        elif isinstance(node, ast.ImportFrom):
            allowed = ANNOTATIONS if node.module == "typing" else MEMBERS.get(node.module or "", ())
            for alias in node.names:
                if node.level or alias.name not in allowed:
                    return False
                (hints if node.module == "typing" else bound).add(alias.asname or alias.name)
        elif isinstance(node, ast.FunctionDef):
            bound.add(node.name)
            annotations.append(node.returns)
        elif isinstance(node, ast.arg):
            bound.add(node.arg)
            annotations.append(node.annotation)
        elif isinstance(node, ast.AnnAssign):
            annotations.append(node.annotation)
        elif isinstance(node, ast.ExceptHandler) and node.name:
            bound.add(node.name)
        elif isinstance(node, ast.Name) and not isinstance(node.ctx, ast.Load):
            bound.add(node.id)
    if bound & (BUILTINS | set(modules) | hints):
        return False  # a name with two meanings: not worth telling apart
    in_annotation = {id(n) for a in annotations if a is not None for n in ast.walk(a)}
    owners = set()
    for node in nodes:
        noted = id(node) in in_annotation
        if isinstance(node, ast.Constant) and noted and isinstance(node.value, str):
            return False
        if isinstance(node, ast.Attribute):
            if not isinstance(node.ctx, ast.Load):
                return False
            owner = node.value.id if isinstance(node.value, ast.Name) else None
            if owner in modules:
                allowed = MEMBERS[modules[owner]]
            else:
                allowed = ANNOTATIONS if noted and owner in hints else METHODS
            if node.attr not in allowed:
                return False
            owners.add(id(node.value))
        elif isinstance(node, (ast.Await, ast.Yield, ast.YieldFrom)):
            return False
    for node in nodes:
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            if node.id in modules:
                if id(node) not in owners:
                    return False
            elif node.id in hints:
                if id(node) not in in_annotation:
                    return False
            elif node.id not in bound | BUILTINS and (hasattr(builtins, node.id) or node.id.startswith("__")):
                return False  # a name that nothing binds is an error and no more
    return True


def parse(source):
    try:
        return ast.parse(source)
    except BaseException:
        return None


def load(tree, namespace):
    """The function a verifier defines, in a namespace holding only ``json``."""
    namespace.update(__name__="__main__", json=json)
    exec(compile(tree, "<verifier>", "exec"), namespace)
    return namespace["evaluate"]


def judge(function, text):
    try:
        outcome = function(text)
        code = TRUTHY if outcome else 0
        if outcome == True:  # noqa: E712 - the comparison itself is the verdict
            code |= EQ_TRUE
        if outcome == False:  # noqa: E712
            code |= EQ_FALSE
        return code
    except BaseException:
        return ERROR


class Replies:
    """Step codes on their way to the parent, sent at most ``FLUSH_SECONDS`` late.

    In careful mode every step is sent at once, so that a death shows where it happened.
    """

    def __init__(self, pipe, careful):
        self._pipe, self._careful = pipe, careful
        self._held = bytearray()
        self._sent = time.monotonic()

    def add(self, code):
        self._held.append(code)
        if self._careful or time.monotonic() - self._sent > FLUSH_SECONDS:
            self.flush()

    def flush(self):
        while self._held:
            del self._held[: os.write(self._pipe, self._held)]
        self._sent = time.monotonic()


def work(trees, inputs, verifier, call, replies):
    me = os.getpid()
    while verifier < len(trees):
        namespace = {}
        try:
            function = load(trees[verifier], namespace)
            compiled = True
        except BaseException:
            compiled = False
        if os.getpid() != me:  # a verifier forked: its copy must not answer
            os._exit(0)
        if call < 0:
            replies.add(COMPILED if compiled else BROKEN)
            call = 0
        if compiled:
            for text in inputs[call:]:
                code = judge(function, text)
                if os.getpid() != me:
                    os._exit(0)
                replies.add(code)
        namespace.clear()  # functions point back at it: free it now, not at some collection
        verifier, call = verifier + 1, -1
    replies.flush()


def serve(request, requests, pipe):
    sources, inputs, verifier, call, limit, careful = request
    # The parent enforces the limit per call. The alarm ends a run whose parent is lost.
    alarm = limit * len(sources) * (len(inputs) + 1) + 30
    trees = [parse(source) for source in sources]
    replies = Replies(pipe, careful)
    if all(tree is None or is_plain(tree) for tree in trees):
        signal.setitimer(signal.ITIMER_REAL, alarm)
        work(trees, inputs, verifier, call, replies)
        signal.setitimer(signal.ITIMER_REAL, 0)
        return
    worker = os.fork()
    if worker == 0:
        try:
            os.close(requests)
            signal.setitimer(signal.ITIMER_REAL, alarm)
            work(trees, inputs, verifier, call, replies)
        finally:
            os._exit(0)
    os.waitpid(worker, 0)


def main(memory, path):
    sys.path[:] = path  # only now: what this file imports is the standard library's
    importlib.util.find_spec("no_such_module")  # fills the folder caches that forks inherit
    requests, replies = os.dup(0), os.dup(1)
    blank = os.open(os.devnull, os.O_RDWR)
    for stream in (0, 1, 2):
        os.dup2(blank, stream)
    incoming = os.fdopen(requests, "rb")
    signal.signal(signal.SIGALRM, signal.SIG_DFL)
    gc.freeze()
    while True:
        head = incoming.read(8)
        if len(head) < 8:
            return
        size = struct.unpack("<Q", head)[0]
        if memory:  # on top of what the request itself takes, however long its texts are
            resource.setrlimit(resource.RLIMIT_AS, (memory + 4 * size, resource.RLIM_INFINITY))
        request = marshal.loads(incoming.read(size))
        serve(request, requests, replies)
        os.write(replies, bytes([DONE]))


if __name__ == "__main__":
    main(int(sys.argv[1]), sys.argv[2:])
