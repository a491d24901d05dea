"""Learning how far to recompute: a small Q-learner nudges the community size from step to step."""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..graph import PropertyGraph
from ..operators import metrics
from ..plans.query import PatternQuery
from ..storage import remove
from .incremental import IncrementalMatcher, step_list

SMALLER, LARGER, HOLD = 0, 1, 2
MOST_REWARD = 100.0


def reward(elapsed: float, most: float = MOST_REWARD) -> float:
    """More for quicker steps."""
    return min(most, most / elapsed) if elapsed > 0 else most


class MatchingEnvironment:
    """A step of the replay for each action; observed are edges for each vertex, and the share of communities affected."""

    actions = 3

    def __init__(self, graph: PropertyGraph, query: PatternQuery, base_steps: int, max_steps: int, clock: Callable[[], float] = time.time, largest: int | None = None, **options):
        self.whole, self.query, self.base_steps, self.clock = graph, query, base_steps, clock
        self.steps = step_list(graph)[base_steps : base_steps + max_steps]
        self.options = {"mode": "guided", **options}
        self.largest = largest
        self.reset()

    def reset(self) -> np.ndarray:
        steps = step_list(self.whole)
        base = self.whole.up_to(steps[min(self.base_steps, len(steps)) - 1])
        summary = metrics.component_size_summary(base).first()
        self.most = self.largest or int(summary.largest_size or 1)
        self.threshold = max(1, min(self.most, int(summary.median_size or 1)))
        self.matcher = IncrementalMatcher(base, self.query, community_size=self.threshold, **self.options)
        self.count, self.share = 0, 0.0
        return self.observation()

    def rewind(self) -> None:
        """The same steps again, over the graph as it is now."""
        self.count = 0

    def seed(self, seed: int | None = None) -> list[int | None]:
        """Nothing here is drawn at random; the policies draw, and have seeds of their own."""
        return [seed]

    def render(self) -> str:
        """The state as a line of text."""
        done = self.matcher.metrics[-1] if self.matcher.metrics else None
        said = f", {done.new} new patterns in {done.elapsed:.3f} s" if done else ""
        return f"step {self.count} of {len(self.steps)}, threshold {self.threshold} of {self.most}, {self.share:.3f} of the communities affected{said}"

    def close(self) -> None:
        """Deletes the matcher's tables. Only reset() makes the environment usable again."""
        remove(self.matcher.spark, self.matcher.state)

    def observation(self) -> np.ndarray:
        return np.array([metrics.density(self.matcher.graph).first()["density"] or 0.0, self.share])

    def move(self, action: int) -> None:
        if action == SMALLER and self.threshold > 1:
            self.threshold -= 1
        elif action == LARGER and self.threshold < self.most:
            self.threshold += 1

    def step(self, action: int) -> tuple[np.ndarray, float, bool, dict]:
        self.move(action)
        self.matcher.community_size = self.threshold
        number = self.steps[self.count]
        began = self.clock()
        done = self.matcher.step(self.whole.edges.filter(self.whole.edges["add"] == number), number, self.whole.vertices)
        elapsed = self.clock() - began
        counts = self.matcher.affected.first() if self.matcher.affected is not None else None
        self.share = counts.affected / counts.total if counts and counts.total else 0.0
        self.count += 1
        return self.observation(), reward(elapsed), self.count >= len(self.steps), {"threshold": self.threshold, "metrics": done}


def epsilon_greedy(values: np.ndarray, rng: random.Random, epsilon: float = 0.1) -> int:
    return rng.randrange(len(values)) if rng.random() < epsilon else int(np.argmax(values))


def greedy(values: np.ndarray, rng: random.Random) -> int:
    return int(np.argmax(values))


def boltzmann(values: np.ndarray, rng: random.Random, temperature: float = 1.0) -> int:
    w = np.exp(np.clip((values - values.max()) / temperature, -500, 0))
    return rng.choices(range(len(values)), weights=list(w))[0]


POLICIES = {"epsilon_greedy": epsilon_greedy, "greedy": greedy, "boltzmann": boltzmann}


@dataclass
class QLearner:
    """Values of actions from the last `window` observations, by a network of two layers of four; replay of the last `memory` steps."""

    observed: int = 2
    actions: int = 3
    window: int = 5
    hidden: int = 4
    rate: float = 1e-2
    follow: float = 1e-2
    memory: int = 20
    discount: float = 0.99
    policy: str = "epsilon_greedy"
    seed: int = 0
    replay: deque = field(init=False)

    def __post_init__(self):
        if self.policy not in POLICIES:
            raise ValueError(f"no policy {self.policy}; there are {', '.join(POLICIES)}")
        rng, self.rng = np.random.default_rng(self.seed), random.Random(self.seed)
        sizes = [self.window * self.observed, self.hidden, self.hidden, self.actions]
        self.weights = [x for a, b in zip(sizes, sizes[1:], strict=False) for x in (rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b))]
        self.target = [w.copy() for w in self.weights]
        self.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        self.updates, self.replay, self.seen = 0, deque(maxlen=self.memory), deque(maxlen=self.window)

    def state(self, observation: np.ndarray) -> np.ndarray:
        """The last observations flat, zeros before the first."""
        self.seen.append(np.asarray(observation, float))
        return np.concatenate([np.zeros(self.observed)] * (self.window - len(self.seen)) + list(self.seen))

    @staticmethod
    def _forward(weights: list, x: np.ndarray) -> list:
        layers = [x]
        for i in range(0, len(weights), 2):
            x = x @ weights[i] + weights[i + 1]
            layers.append(np.maximum(x, 0) if i + 2 < len(weights) else x)
            x = layers[-1]
        return layers

    def values(self, state: np.ndarray) -> np.ndarray:
        return self._forward(self.weights, state[None])[-1][0]

    def act(self, state: np.ndarray, learn: bool = True) -> int:
        return POLICIES[self.policy if learn else "greedy"](self.values(state), self.rng)

    def learn(self, state: np.ndarray, action: int, gain: float, following: np.ndarray, last: bool) -> float:
        """Remembers a step and fits the network to what is remembered; returns the loss."""
        self.replay.append((state, action, gain, following, last))
        s, a, g, f, end = (np.array(x) for x in zip(*self.replay, strict=True))
        wanted = g + self.discount * (1 - end) * self._forward(self.target, f)[-1].max(1)
        layers = self._forward(self.weights, s)
        error = layers[-1][np.arange(len(a)), a] - wanted
        slope = np.zeros_like(layers[-1])
        slope[np.arange(len(a)), a] = np.clip(error, -1, 1) / len(a)
        grads = []
        for i in range(len(self.weights) - 2, -1, -2):
            grads = [layers[i // 2].T @ slope, slope.sum(0), *grads]
            slope = (slope @ self.weights[i].T) * (layers[i // 2] > 0)
        self.updates += 1
        for k, grad in enumerate(grads):  # Adam
            m, v = self.moments[k]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            self.moments[k] = m, v
            self.weights[k] = self.weights[k] - self.rate * (m / (1 - 0.9**self.updates)) / (np.sqrt(v / (1 - 0.999**self.updates)) + 1e-8)
            self.target[k] = (1 - self.follow) * self.target[k] + self.follow * self.weights[k]
        return float((error**2).mean())


def episode(environment, learner: QLearner, steps: int, learn: bool = True) -> list[dict]:
    """Up to so many steps; one entry each."""
    learner.seen.clear()
    state, out = learner.state(environment.observation()), []
    for _ in range(steps):
        action = learner.act(state, learn)
        observation, gain, last, info = environment.step(action)
        following = learner.state(observation)
        loss = learner.learn(state, action, gain, following, last) if learn else None
        out.append({"action": action, "reward": gain, "loss": loss, **info})
        state = following
        if last:
            break
    return out


def train_and_test(graph: PropertyGraph, query: PatternQuery, base_steps: int, max_steps: int, policy: str = "epsilon_greedy", **options) -> tuple[list[dict], list[dict], QLearner]:
    """The first half of the steps to learn from, the other half to test on; with the greedy policy all of them for both."""
    learner, half = QLearner(policy=policy), max_steps // 2
    first = MatchingEnvironment(graph, query, base_steps, max_steps if policy == "greedy" else half, **options)
    learnt = episode(first, learner, max_steps)
    second = MatchingEnvironment(graph, query, base_steps if policy == "greedy" else base_steps + half, max_steps if policy == "greedy" else max_steps - half, **options)
    return learnt, episode(second, learner, max_steps, learn=False), learner
