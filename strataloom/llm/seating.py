"""Chinese-restaurant seating of many dishes at once, moved by Gibbs sampling."""

from __future__ import annotations

import math

import numpy as np

TINY = 1e-100  # least mass and weight, where a draw comes to 0


def new_sizes(z: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Customers of new tables: k with chance as (1 - d)(2 - d)...(k - 1 - d) z^k / k!, by rejection from z = 1."""
    out, todo = np.zeros(len(z), np.int64), np.arange(len(z))
    z = np.minimum(z, 1 - 1e-15)
    while len(todo):
        ends = rng.beta(discount, 1 - discount, len(todo))
        with np.errstate(divide="ignore"):
            k = 1.0 + np.floor(np.log(rng.random(len(todo))) / np.log1p(-np.maximum(ends, TINY)))
        good = rng.random(len(todo)) < z[todo] ** (k - 1)
        out[todo[good]] = k[good].astype(np.int64)
        todo = todo[~good]
    return out


def unseen_mass(weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Mass of all tables nobody sits at: tempered stable with mean `weight`, by rejection from the stable law in pieces."""
    pieces = np.maximum(1, np.ceil(weight / discount)).astype(np.int64)
    of = np.repeat(np.arange(len(weight)), pieces)
    scale = np.log(np.maximum(weight / discount / pieces, TINY))[of] / discount
    out, todo, d = np.zeros(len(weight)), np.arange(len(of)), discount
    while len(todo):
        angle = np.pi * (1 - rng.random(len(todo)))
        a = np.log(np.maximum(np.sin((1 - d) * angle), TINY)) + d / (1 - d) * np.log(np.maximum(np.sin(d * angle), TINY)) - np.log(np.maximum(np.sin(angle), TINY)) / (1 - d)
        s = np.exp(np.minimum(scale[todo] + (a - np.log(rng.standard_exponential(len(todo)))) * (1 - d) / d, 700))
        good = rng.random(len(todo)) < np.exp(-s)
        out += np.bincount(of[todo[good]], s[good], len(weight))
        todo = todo[~good]
    return out


def some(dish: np.ndarray, held: np.ndarray, wanted: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of the customers at each table are among `wanted` of each dish, drawn without replacement.

    `dish` of each table ascends; no dish has fewer customers than are wanted.
    """
    n = len(wanted)
    whole = np.bincount(dish, held, n).astype(np.int64)
    drop = whole - wanted < wanted  # the smaller part is drawn
    todo = np.where(drop, whole - wanted, wanted)
    last = np.cumsum(whole)
    seen, lack = np.zeros(0, np.int64), np.repeat(np.arange(n), todo)
    while len(lack):
        seen = np.sort(np.r_[seen, (last - whole)[lack] + (rng.random(len(lack)) * whole[lack]).astype(np.int64)])
        twice = np.flatnonzero(seen[1:] == seen[:-1])
        lack = np.searchsorted(last, seen[twice], side="right")  # drawn once more
        seen = np.delete(seen, twice)
    drawn = np.diff(np.searchsorted(seen, np.cumsum(held)), prepend=0)
    return np.where(drop[dish], held - drawn, drawn)


class Seating:
    """Tables of restaurants; a dish belongs to one restaurant, and all dishes are numbered 0 to n - 1.

    At first the customers of a dish share one table. A Gibbs move takes one random customer of each dish away
    and seats it again: at a table of its dish by its size less the discount, or at a new one. `reseat` does so
    with all customers of all dishes in one step.
    """

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator):
        self.customers = customers.astype(np.int64).copy()
        self.discount, self.rng = discount, rng
        self.dish = np.flatnonzero(self.customers)
        self.size = self.customers[self.dish].copy()
        self.tables = (self.customers > 0).astype(np.int64)

    def _tidy(self, extra: np.ndarray) -> None:
        dish, size = np.concatenate((self.dish, extra)), np.concatenate((self.size, np.ones(len(extra), np.int64)))
        held = size > 0
        dish, size = dish[held], size[held]
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], size[order]
        self.tables = np.bincount(self.dish, minlength=len(self.customers))

    def _pick(self, dishes: np.ndarray) -> np.ndarray:
        """A table of each dish, by size; no dish may stand there twice, and each has a customer."""
        ends = np.cumsum(self.size)
        first = np.searchsorted(self.dish, dishes)
        base = ends[first] - self.size[first]
        draw = base + (self.rng.random(len(dishes)) * self.customers[dishes]).astype(np.int64)
        return np.searchsorted(ends, draw, side="right")

    def remove(self, dishes: np.ndarray) -> np.ndarray:
        """One customer of each dish leaves; which of their tables are gone."""
        at = self._pick(dishes)
        self.size[at] -= 1
        self.customers[dishes] -= 1
        gone = self.size[at] == 0
        if gone.any():
            self._tidy(np.zeros(0, np.int64))
        return gone

    def add(self, dishes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One more customer for each dish; weight: (strength + discount * tables of the restaurant) * base probability.

        Tells which sit at new tables.
        """
        held = np.maximum(self.customers[dishes] - self.discount * self.tables[dishes], 0.0)
        new = (self.customers[dishes] == 0) | (self.rng.random(len(dishes)) * (weight + held) < weight)
        old = dishes[~new]
        if len(old):
            at = self._pick(old)
            tried = np.arange(len(old))
            while len(tried):  # a table is left again with probability discount / size
                tried = tried[self.rng.random(len(tried)) * self.size[at[tried]] < self.discount]
                at[tried] = self._pick(old[tried])
            self.size[at] += 1
        self.customers[dishes] += 1
        if new.any():
            self._tidy(dishes[new])
        return new

    def move(self, dishes: np.ndarray, weight) -> tuple[np.ndarray, np.ndarray]:
        """A Gibbs move for each dish; weight() gives the weight of a new table. Dishes that lost and that won a table."""
        dishes = dishes[self.customers[dishes] > 1]
        lost = dishes[self.remove(dishes)] if len(dishes) else dishes
        won = dishes[self.add(dishes, weight(dishes))] if len(dishes) else dishes
        return lost, won

    def masses(self, weight: np.ndarray) -> np.ndarray:
        """Mass of each dish given the seats: of its tables, and of those nobody sits at; weight as in `add`."""
        own = np.maximum(self.customers - self.discount * self.tables, TINY)
        return self.rng.standard_gamma(own) + unseen_mass(weight, self.discount, self.rng)

    def renew(self, weight: np.ndarray) -> None:
        """Draw the seats of frequent dishes anew, which `reseat` moves slowly: a Metropolis step that keeps its law.

        All tables but the largest are proposed from the Poisson process of tables, and the largest takes the other
        customers. Dishes are tried where this is likely to be accepted, which their customers and weight alone decide.
        """
        d, rng, c = self.discount, self.rng, self.customers
        tried = np.flatnonzero(c >= 32)
        tried = tried[np.log(np.maximum(weight[tried] / d, TINY)) / d < np.log(c[tried] / 8)]
        place = np.full(len(c), -1)
        place[tried] = np.arange(len(tried))
        at = place[self.dish]
        largest = np.zeros(len(tried), np.int64)
        np.maximum.at(largest, at[at >= 0], self.size[at >= 0])
        alone = np.bincount(at[at >= 0], self.size[at >= 0] == largest[at[at >= 0]], len(tried)) == 1
        fresh = np.repeat(np.arange(len(tried)), rng.poisson(weight[tried] / d))
        sizes = np.minimum(new_sizes(np.ones(len(fresh)), d, rng), c[tried][fresh] + 1)
        rest = c[tried] - np.bincount(fresh, sizes, len(tried)).astype(np.int64)
        most = np.zeros(len(tried), np.int64)
        np.maximum.at(most, fresh, sizes)
        fits = alone & (rest > most)
        chance = np.vectorize(lambda m: math.lgamma(m - d) - math.lgamma(m + 1), otypes=[float])
        fits[fits] = np.log(rng.random(fits.sum())) < chance(rest[fits]) - chance(largest[fits])
        taken = np.flatnonzero(fits)
        kept = ~np.isin(self.dish, tried[taken])
        new = fits[fresh]
        dish = np.r_[self.dish[kept], tried[taken], tried[fresh[new]]]
        size = np.r_[self.size[kept], rest[taken], sizes[new]]
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], size[order]
        self.tables = np.bincount(self.dish, minlength=len(c))

    def reseat(self, customers: np.ndarray, weight: np.ndarray) -> None:
        """Every customer leaves and `customers` of each dish sit down, all in one exact Gibbs step; weight as in `add`.

        Given masses of all tables, customers choose by mass, each on its own. Tables in use have gamma masses;
        the rest are a Poisson process of masses with density weight / gamma(1 - d) m^(-1 - d) e^-m, of which only tables
        that somebody comes to are drawn. Customers come to a table at its mass as rate until there are enough.
        """
        d, rng = self.discount, self.rng
        moved = np.flatnonzero((self.customers > 1) | (customers > 1))
        n = len(moved)
        place = np.full(len(customers), -1)
        place[moved] = np.arange(n)
        kept = place[self.dish] < 0
        at = place[self.dish[~kept]]
        mass = np.maximum(rng.standard_gamma(self.size[~kept] - d), TINY)
        size = np.zeros(len(at), np.int64)
        left, w, time = customers[moved].astype(np.int64), np.maximum(weight[moved], TINY), np.ones(n)
        while (left > 0).any():
            rate = np.bincount(at, mass, n) + w * time ** (d - 1)
            step = np.where(left > 0, (left + 2 * np.sqrt(left)) / rate, 0.0)
            live = np.flatnonzero(step[at] > 0)
            come = rng.poisson(step[at[live]] * mass[live])
            fresh = np.repeat(np.arange(n), rng.poisson(w / d * time**d * np.expm1(d * np.log1p(step / time))))
            time += step
            sizes = new_sizes((step / time)[fresh], d, rng)
            dish, held = np.r_[at[live], fresh], np.r_[come, sizes]
            order = np.argsort(dish, kind="stable")
            got = np.bincount(dish, held, n).astype(np.int64)
            counted = np.empty(len(dish), np.int64)
            counted[order] = some(dish[order], held[order], np.minimum(got, left), rng)
            left -= np.minimum(got, left)
            size[live] += counted[: len(live)]
            at, size = np.r_[at, fresh], np.r_[size, counted[len(live) :]]
            mass = np.r_[mass, np.maximum(rng.standard_gamma(sizes - d) / time[fresh], TINY)]
        self.customers = customers.astype(np.int64).copy()
        used = size > 0
        dish, size = np.r_[self.dish[kept], moved[at[used]]], np.r_[self.size[kept], size[used]]
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], size[order]
        self.tables = np.bincount(self.dish, minlength=len(self.customers))
