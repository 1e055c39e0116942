"""Files that end the process which walks them.

A first attempt at a task walks its files in the worker itself, at no cost. If a file ends the worker (a crash, memory, an
error that no walker foresaw), Spark repeats the task elsewhere; attempts after the first walk each batch in a process
of its own. A batch whose process ends early is halved and both halves are walked again, down to the one file that does it,
which gets an error row. So its neighbours keep all their results, and a batch of n files costs at most about log2(n)
repeated walks for each such file.

Defined results: an error of kind `malformed` with detail `walk-failed` (an exception), `walk-ended` (the process was
ended) or `walk-unfinished` (not done within the seconds allowed to a file and to each of those walked with it).
"""

from __future__ import annotations

import os
import pickle
import signal
import sys
from collections.abc import Callable

from pyspark import TaskContext, cloudpickle


#: Files that are walked at a time: what they become in Python is many times what they are in Arrow.
LOT = 1_000


def lots(batches):
    """Arrow batches, cut into lots."""
    for batch in batches:
        for start in range(0, batch.num_rows, LOT):
            yield batch.slice(start, LOT)


def repeated() -> bool:
    """Whether this task was attempted before."""
    task = TaskContext.get()
    return task is not None and task.attemptNumber() > 0


def apart(work: Callable, rows: list[tuple], seconds: int) -> tuple[list | None, str | None]:
    """What work gives for each row, from a process of its own; or why that process did not come to its end."""
    read, write = os.pipe()
    child = os.fork()
    if child == 0:
        code = 1
        try:
            os.close(read)
            signal.signal(signal.SIGALRM, signal.SIG_DFL)
            signal.setitimer(signal.ITIMER_REAL, seconds * len(rows))
            done = pickle.dumps([work(*r) for r in rows], protocol=5)
            signal.setitimer(signal.ITIMER_REAL, 0)
            with os.fdopen(write, "wb") as out:
                out.write(done)
            code = 0
        finally:
            os._exit(code)  # neither the worker's buffers nor its exit handlers are the child's to run
    os.close(write)
    with os.fdopen(read, "rb") as given:
        done = given.read()
    status = os.waitpid(child, 0)[1]
    if os.WIFSIGNALED(status):
        return None, "walk-unfinished" if os.WTERMSIG(status) == signal.SIGALRM else "walk-ended"
    return (pickle.loads(done), None) if os.WEXITSTATUS(status) == 0 else (None, "walk-failed")


def isolated(work: Callable, rows: list[tuple], refuse: Callable, seconds: int = 60) -> list:
    """What work gives for each row, in order; refuse(why) for each row that ends its process."""
    if not rows:
        return []
    done, why = apart(work, rows, seconds)
    if done is not None:
        return done
    if len(rows) == 1:
        return [refuse(why)]
    half = len(rows) // 2
    return isolated(work, rows[:half], refuse, seconds) + isolated(work, rows[half:], refuse, seconds)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
