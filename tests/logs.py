"""A builder of session logs for tests: one object a file, a clock that each step moves on."""

import json
from datetime import UTC, datetime, timedelta


class Log:
    def __init__(self, at: str = "2025-03-04T09:00:00", model: str = "alpha", **state):
        self.now, self.lines, self.sum = datetime.fromisoformat(at).replace(tzinfo=UTC), [], 0
        self.state("session_meta", model=model, **state)

    def wait(self, **span) -> "Log":
        self.now += timedelta(**span)
        return self

    def put(self, kind: str, payload: dict) -> "Log":
        self.lines.append(json.dumps({"type": kind, "payload": payload, "timestamp": self.now.strftime("%Y-%m-%dT%H:%M:%S.%fZ")}))
        return self

    def raw(self, line: str) -> "Log":
        self.lines.append(line)
        return self

    def state(self, kind: str = "turn_context", **payload) -> "Log":
        return self.put(kind, payload)

    def spend(self, tokens: int = 700, answer: int = 30, cached: int = 0, total: int | None = None, percent: float | None = None, resets: int = 1_741_600_000, last: bool = True, **odd) -> "Log":
        """A usage record; ``total`` 0 or more puts a cumulative counter, ``percent`` a weekly meter beside it."""
        own = {"input_tokens": tokens, "cached_input_tokens": cached, "output_tokens": answer, "reasoning_output_tokens": 1} | odd
        info = {"last_token_usage": own} if last else {}
        if total is not None:
            info["total_token_usage"] = {"input_tokens": total, "output_tokens": 7, "cached_input_tokens": 3}
        payload = {"type": "token_count", "info": info}
        if percent is not None:
            payload["rate_limits"] = {"limit_id": "codex", "secondary": {"used_percent": percent, "window_minutes": 10080, "resets_at": resets}}
        return self.put("event_msg", payload)

    def save(self, path) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(self.lines))
