"""Control rules around runs: identities, limits, projections, decisions, state machines. Small values, no tables."""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field


class GovernanceError(Exception):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


def _canonical(value) -> bytes:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode("utf-8")


def checksum(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def run_id(fingerprint: dict) -> str:
    """The id of a run: 24 hex digits of its canonical fingerprint."""
    return "run_" + hashlib.sha256(_canonical(fingerprint)).hexdigest()[:24]


def check_run(manifest: dict) -> None:
    """A stored run id must be that of its fingerprint, and output checksums must be well formed."""
    if manifest.get("run_id") != run_id(manifest["fingerprint"]):
        raise GovernanceError("RUN_ID_MISMATCH")
    bad = [k for k, v in manifest.get("outputs", {}).items() if not re.fullmatch(r"sha256:[0-9a-f]{64}", v)]
    if bad:
        raise GovernanceError("OUTPUT_CHECKSUM", ", ".join(bad))


def check_outputs(manifest: dict, outputs: dict[str, bytes]) -> None:
    wrong = [k for k, v in manifest["outputs"].items() if checksum(outputs.get(k, b"")) != v]
    if wrong or set(outputs) != set(manifest["outputs"]):
        raise GovernanceError("OUTPUT_MISMATCH", ", ".join(wrong))


def check_telemetry(manifest: dict, telemetry: dict) -> None:
    if telemetry.get("run_id") != manifest.get("run_id"):
        raise GovernanceError("TELEMETRY_LINK")


def safe_relative_path(path: str) -> str:
    """A normal relative POSIX path that stays inside its root."""
    parts = path.split("/")
    if not path or path.startswith("/") or "\\" in path or re.match("[A-Za-z]:", path) or any(p in ("", ".", "..") for p in parts):
        raise GovernanceError("PATH_UNSAFE", path)
    return path


def retry_delay(attempt: int) -> int:
    """Seconds before attempt 2, 3 and 4."""
    if not 1 <= attempt <= 3:
        raise GovernanceError("RETRY_EXHAUSTED", str(attempt))
    return 2 ** (attempt - 1)


@dataclass
class Lifecycle:
    """Steps that must be taken in order, each once, with the receipts that some of them need."""

    steps: tuple[str, ...]
    receipts: frozenset[str] = frozenset()
    done: list[str] = field(default_factory=list)

    def mark(self, step: str, receipt: str | None = None) -> None:
        if len(self.done) == len(self.steps) or self.steps[len(self.done)] != step:
            raise GovernanceError("LIFECYCLE_ORDER", step)
        if step in self.receipts and not receipt:
            raise GovernanceError("LIFECYCLE_RECEIPT", step)
        self.done.append(step)

    @property
    def complete(self) -> bool:
        return len(self.done) == len(self.steps)


# fixed values: steps of remote retrieval and of adapter training
def retrieval_lifecycle() -> Lifecycle:
    return Lifecycle(("created", "deleted", "absence_verified"), frozenset({"deleted"}))


def training_lifecycle() -> Lifecycle:
    return Lifecycle(("preflight", "remote_run", "download", "volume_deleted"))


@dataclass
class Submission:
    """At most four attempts and a single job id."""

    attempts: int = 0
    job_id: str | None = None

    def attempt(self) -> int:
        if self.job_id is not None or self.attempts >= 4:
            raise GovernanceError("SUBMISSION_ATTEMPTS")
        self.attempts += 1
        return self.attempts

    def record(self, job_id: str) -> None:
        if self.job_id not in (None, job_id):
            raise GovernanceError("SUBMISSION_JOB")
        self.job_id = job_id


def parameter_total(components: dict[str, int], limit: int = 4_000_000_000) -> int:
    """The sum of positive counts, under an exclusive limit."""
    if any(not isinstance(n, int) or n <= 0 for n in components.values()):
        raise GovernanceError("PARAMETER_COUNT")
    total = sum(components.values())
    if total >= limit:
        raise GovernanceError("PARAMETER_LIMIT", str(total))
    return total


def blocking_codes(checks: dict[str, bool]) -> list[str]:
    """The codes of the gates that are not met, in order; empty means authorised."""
    return [code for code, ok in checks.items() if not ok]


def model_gates(profile: dict) -> list[str]:
    """What keeps a model profile from official use."""
    return blocking_codes({
        "MODEL_REVISION": bool(re.fullmatch(r"[0-9a-f]{40}", profile.get("revision", ""))), "TOKENIZER_REVISION": bool(re.fullmatch(r"[0-9a-f]{40}", profile.get("tokenizer_revision", ""))),
        "LICENSE": bool(profile.get("license")), "PARAMETER_AUDIT": profile.get("parameters", 0) > 0 and bool(profile.get("audit_checksum")), "REGISTRATION": bool(profile.get("registration")),
    })


def sparse_preflight(sample: int, seconds: float, total: int, workers: int, cap: float) -> dict:
    """The projected time of a whole run from a sample, and whether it keeps the cap."""
    if sample < 1 or total < sample or seconds <= 0 or workers < 1 or not math.isfinite(seconds):
        raise GovernanceError("PREFLIGHT_INPUT")
    projected = seconds / sample * total
    return {"seconds_per_query": seconds * workers / sample, "projected_seconds": projected, "within_cap": projected <= cap}


def sample_timeout(cap: float, sample: int, total: int) -> float:
    """The time after which a sample shows that the whole will miss its cap."""
    return cap * sample / total


def dense_preflight(documents: int, per_second: float, dimension: int, cap: float, bytes_per_value: int = 2) -> dict:
    projected = documents / per_second
    return {"projected_seconds": projected, "vector_bytes": documents * dimension * bytes_per_value, "within_cap": projected <= cap}


def bottleneck(discovery_recall: float, ranking_recall: float, oracle_score: float, actual_score: float, margin: float = 0.05) -> str:
    """What limits answers most: finding evidence, ranking it, or generating from it."""
    if discovery_recall < 1 - margin and discovery_recall - ranking_recall <= margin:
        return "DISCOVERY"
    if discovery_recall - ranking_recall > margin:
        return "RANKING"
    return "GENERATION" if oracle_score - actual_score <= margin else "SELECTION"


def cost_allowed(before: float, projected: float, ceiling: float) -> bool:
    return math.isfinite(before + projected) and before >= 0 and projected >= 0 and before + projected <= ceiling


def check_response(request_ids: list[str], response: list[dict]) -> None:
    """A remote response must name the asked ids in order with consecutive ranks and no pair twice."""
    seen, order = set(), []
    for row in response:
        key = row["question_id"], row["chunk_id"]
        if key in seen:
            raise GovernanceError("RESPONSE_DUPLICATE", str(key))
        seen.add(key)
        if not order or order[-1][0] != row["question_id"]:
            order.append([row["question_id"], 0])
        order[-1][1] += 1
        if row["rank"] != order[-1][1]:
            raise GovernanceError("RESPONSE_RANK", str(key))
    if [q for q, _ in order] != request_ids:
        raise GovernanceError("RESPONSE_ORDER")
