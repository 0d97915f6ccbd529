"""Small trajectories in the entry schema."""

from __future__ import annotations

import json

from runlens import schemas

#: Calls of an assistant that keeps a calendar and a mailbox: two that look, two that change.
FIND = ("calendar_find_event", {"query": "review", "limit": 3})
READ = ("mail_read_message", {"message_id": "m4", "headers": False})


def move(event, day):
    return ("calendar_move_event", {"event_id": event, "day": day})


def send(message, body):
    return ("mail_send_message", {"message_id": message, "body": body})


def sh(command):
    return ("run_shell_command", {"command": command})


def finish(answer):
    return ("finish", {"answer": answer})


def entries(rollout, steps, outputs=None):
    """Entry tuples; a step is a text (content-only reply) or a list of (tool, arguments)."""
    outputs, out, order = outputs or {}, [], 0
    for number, spec in enumerate(steps, start=1):
        calls = [] if isinstance(spec, str) else [(f"c{number}_{i}", n, json.dumps(a, ensure_ascii=False)) for i, (n, a) in enumerate(spec)]
        content = spec if isinstance(spec, str) else ""
        out.append((rollout, order, number, "assistant", (content, None, calls), None, None, (10, 5, 4), 1000.0 + number))
        order += 1
        for i, call in enumerate(calls):
            default = {"stdout": f"out{number}", "stderr": "", "exit_code": 0} if call[1] == "run_shell_command" else {}
            o = outputs.get(number, default) if i == 0 else default
            text = o.get("content", json.dumps(o))
            out.append((rollout, order, number, "tool", None, call,
                        (text, o.get("stdout"), o.get("stderr"), o.get("exit_code"), o.get("timeout"), 0.1), None, 1000.5 + number))
            order += 1
    return out


def frame(spark, *groups):
    return spark.createDataFrame([e for g in groups for e in g], schemas.ENTRY)
