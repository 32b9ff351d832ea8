"""Log lines as JSON objects with the run's id."""

from __future__ import annotations

import json
import logging
import sys

from editwake.sinks import RUN_ID

_OWN = set(logging.makeLogRecord({}).__dict__) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        body = {"time": self.formatTime(record), "level": record.levelname.lower(), "event": record.getMessage(), "run_id": RUN_ID}
        body |= {k: v for k, v in record.__dict__.items() if k not in _OWN}
        if record.exc_info:
            body["error"] = self.formatException(record.exc_info)
        return json.dumps(body, ensure_ascii=False, default=str)


def configure(level: int = logging.INFO) -> str:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines())
    root = logging.getLogger("editwake")
    root.handlers, root.propagate = [handler], False
    root.setLevel(level)
    return RUN_ID
