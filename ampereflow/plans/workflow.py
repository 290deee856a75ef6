"""The sequence of a day-ahead decision: phases, fan-out, failures, hand-offs."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import date, datetime
from typing import Any, Callable, Mapping

from ..errors import ApplicationError, ConflictError, InvalidRequestError, NotFoundError

PHASES = ("contract", "ingestion", "forecasting", "risk_and_bid")
STATUSES = ("running", "failed", "completed")
INGESTION_AGENTS = ("market", "weather", "hydro", "availability", "news")
FORECASTING_AGENTS = ("load", "price")
NEXT = {"ingestion": "forecasting", "forecasting": "risk_and_bid"}


@dataclass(frozen=True)
class State:
    workflow_id: str
    portfolio_id: str
    delivery_date: date
    correlation_id: str
    phase: str = "ingestion"
    status: str = "running"
    diagnostics: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if type(self.delivery_date) is not date or isinstance(self.delivery_date, datetime):
            raise InvalidRequestError("the delivery date must be a plain date")
        if self.phase not in PHASES or self.status not in STATUSES:
            raise InvalidRequestError("unknown phase or status")
        if not all(re.search(r"\S", x) for x in (self.workflow_id, self.portfolio_id, self.correlation_id)):
            raise InvalidRequestError("an identifier is blank")


@dataclass(frozen=True)
class Failure:
    """One agent's failure; ``code`` names known kinds and else says that it was unexpected."""

    agent: str
    code: str
    attempt: int = 1


class AgentError(Exception):
    """A failure that says which agent it belongs to."""

    def __init__(self, agent: str, cause: BaseException):
        super().__init__(agent)
        self.agent, self.cause = agent, cause


def run_all(jobs: Mapping[str, Callable[[], Any]]) -> dict[str, Any]:
    """Run independent jobs at once; all must succeed, and every failure is reported with its agent."""
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        started = {name: pool.submit(job) for name, job in jobs.items()}
        failures, results = [], {}
        for name, future in started.items():
            try:
                results[name] = future.result()
            except Exception as error:
                failures.append(AgentError(name, error))
    if failures:
        raise ExceptionGroup("agents failed", failures)
    return results


def failures_of(group: BaseExceptionGroup, phase: str) -> tuple[Failure, ...]:
    """Failures of a possibly nested group in order; one without an agent is an error itself."""
    out: list[Failure] = []
    for error in group.exceptions:
        if isinstance(error, BaseExceptionGroup):
            out.extend(failures_of(error, phase))
        elif isinstance(error, AgentError):
            code = error.cause.code if isinstance(error.cause, ApplicationError) else f"{phase}_unexpected_failure"
            out.append(Failure(error.agent, code))
        else:
            raise InvalidRequestError("a failure belongs to no agent")
    return tuple(out)


def only(failures: tuple[Failure, ...]) -> Failure:
    if len(failures) != 1:
        raise InvalidRequestError("exactly one failure can be handled")
    return failures[0]


def act(state: State, failure: Failure, action: str = "fail") -> State:
    """Apply the policy's action; only failing is provided."""
    if action != "fail":
        raise NotImplementedError(action)
    return replace(state, status="failed", diagnostics=(*state.diagnostics, f"{failure.agent}:{failure.code}"))


def advance(state: State) -> State:
    if state.status != "running" or state.phase not in NEXT:
        raise InvalidRequestError("the workflow can't advance from here")
    return replace(state, phase=NEXT[state.phase])


class Results:
    """What each workflow planned or reached: written once, equal rewrites ignored, others refused."""

    def __init__(self) -> None:
        self._rows: dict[str, Any] = {}

    def put(self, workflow_id: str, value: Any) -> None:
        if self._rows.setdefault(workflow_id, value) != value:
            raise ConflictError("the workflow has another result")

    def get(self, workflow_id: str) -> Any:
        if workflow_id not in self._rows:
            raise NotFoundError("the workflow has no result")
        return self._rows[workflow_id]


@dataclass(frozen=True)
class Workflow:
    """One call runs one phase: its jobs come from a plan, their results are recorded, the state moves on."""

    plans: Mapping[str, Callable[[State], Mapping[str, Callable[[], Any]]]]
    results: Mapping[str, Results]
    regulatory: Callable[[State], State] | None = None

    def step(self, state: State, policy: Callable[[Failure], str] = lambda _: "fail") -> State:
        if state.status != "running":
            raise InvalidRequestError("the workflow is not running")
        if state.phase == "contract":
            if self.regulatory is None:
                raise InvalidRequestError("no regulatory step is configured")
            return self.regulatory(state)
        if state.phase not in self.plans:
            raise InvalidRequestError("the phase has no step")
        jobs = self.plans[state.phase](state)
        try:
            reached = run_all(jobs)
        except ExceptionGroup as group:
            failure = only(failures_of(group, state.phase))
            return act(state, failure, policy(failure))
        self.results[state.phase].put(state.workflow_id, reached)
        return advance(state)


def assess_risk(state: State, forecasts: Results, calculator: Callable[[State, Any], Any]) -> Any:
    """Hand the stored forecast to the caller's risk calculator."""
    if state.phase != "risk_and_bid" or state.status != "running":
        raise InvalidRequestError("risk is assessed after forecasting")
    return calculator(state, forecasts.get(state.workflow_id))


def propose(state: State, forecasts: Results, risk: Any, strategy: Callable[[State, Any, Any], list]) -> dict[str, Any]:
    """Forecast, risk and the bids that the caller's strategy makes of both."""
    forecast = forecasts.get(state.workflow_id)
    return {"forecast": forecast, "risk": risk, "bids": tuple(strategy(state, forecast, risk))}
