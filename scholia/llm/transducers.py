"""Small deterministic finite-state transducers, their composition, and weights on their arcs."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Transducer:
    """arcs[(state, symbol)] = (next state, output or None). State 0 starts; a symbol without an arc passes through and leaves the state. weights: what an arc adds to its way's weight, 0 if it is not there."""

    arcs: dict
    weights: dict = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str | None]:
        return self.arcs.get((state, symbol), (state, symbol))

    def run(self, symbols: list[str]) -> list[str]:
        state, out = 0, []
        for s in symbols:
            state, o = self.step(state, s)
            if o is not None:
                out.append(o)
        return out


    def weigh(self, symbols: list[str]) -> float:
        """The weight of the way of a string of symbols: the sum over its arcs."""
        state, total = 0, 0.0
        for s in symbols:
            total += self.weights.get((state, s), 0.0)
            state, _ = self.step(state, s)
        return total


def weighted(t: Transducer, by_output: dict[str, float]) -> Transducer:
    """The transducer with a weight on each arc that has an output."""
    return Transducer(t.arcs, {arc: by_output[o] for arc, (_, o) in t.arcs.items() if o in by_output})


def compose(first: Transducer, second: Transducer, alphabet: set[str]) -> Transducer:
    """One transducer that does what second does to the outputs of first, over the reachable pairs of states."""
    number, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
    while todo:
        pair = todo.pop()
        for s in sorted(alphabet):
            a, out = first.step(pair[0], s)
            b = pair[1]
            if out is not None:
                b, out = second.step(b, out)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[pair], s] = (number[a, b], out)
    return Transducer(arcs)


def outputs(t: Transducer) -> set[str]:
    """All symbols that a composed transducer can put out."""
    return {o for _, o in t.arcs.values() if o is not None}
