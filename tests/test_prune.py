from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.catalog import Topology, make_table
from shardloom.prune import UNKNOWN, And, Cmp, Const, In, Not, Or, between, prune, render

ONE = make_table("t", "d_${0..3}", "t_${00..15}", [{"column": "uid", "expr": "($0 % 16) / 4"}], [{"column": "uid", "expr": "$0 % 16"}])
KEYS = [{"name": "uid"}, {"name": "sid"}]
TWO = make_table("t", "d_${0..3}", "t_${00..15}", [{"columns": KEYS, "expr": "(($0*31+$1) % 16) / 4"}], [{"columns": KEYS, "expr": "($0*31+$1) % 16"}])
uid = lambda op, v: Cmp("uid", op, v)


def test_goldens_one_key():
    for p, want in [
        (And((uid("=", 8), Cmp("dummy", "=", 1))), "[2:8]"),
        (And((uid(">", 8), uid("<=", 12))), "[2:9,10,11;3:12]"),
        (Or((uid("=", 1), uid("=", 2), uid("=", 3))), "[0:1,2,3]"),
        (Cmp("a", "=", 1), "*"),
        (Not(Or((uid("=", 1), uid("=", 2)))), "*"),
        (Not(uid("=", 1)), "*"),
        (And((uid("=", 1), uid("<>", 1))), "[]"),
        (And((uid("=", 1), Not(uid("=", 1)))), "[]"),
        (Not(uid("<>", 9)), "[2:9]"),
        (And((uid("=", 5), UNKNOWN)), "[1:5]"),
        (Or((uid("=", 5), UNKNOWN)), "*"),
        (Not(UNKNOWN), "*"),
        (uid(">", 3), "*"),
        (uid("=", None), "[]"),
        (And((uid("=", 5), Const(False))), "[]"),
        (Not(In("uid", (1, 2), True)), "[0:1,2]"),
        (uid("=", 2.5), "[0:2]"),
        (uid("=", "x"), "*"),
        (between("uid", 0, 10**9), "*"),
    ]:
        assert render(prune(p, ONE)) == want, p


def test_goldens_two_keys():
    both = And((uid("=", 8), Cmp("sid", "=", 1)))
    h = (8 * 31 + 1) % 16
    assert prune(both, TWO) == {(h // 4, h)}
    span = And((between("uid", 8, 10), between("sid", 1, 3)))
    want = {((u * 31 + s) % 16 // 4, (u * 31 + s) % 16) for u in (8, 9, 10) for s in (1, 2, 3)}
    assert prune(span, TWO) == want
    assert prune(uid("=", 8), TWO) is None


def test_topology():
    t = Topology.of("e_${0000..0003}", "s_${0000..0031}")
    assert t.grid[1] == tuple(range(8, 16)) and t.render((1, 9)) == ("e_0001", "s_0009")
    assert Topology.of("shop", "e_${0..7}").grid == {0: tuple(range(8))}


values = st.integers(-3, 40)
leaf = st.one_of(
    st.builds(Cmp, st.sampled_from(["uid", "other"]), st.sampled_from(["=", "<>", "<", "<=", ">", ">="]), values),
    st.builds(lambda v, n: In("uid", tuple(v), n), st.lists(values, max_size=3), st.booleans()),
    st.builds(Const, st.booleans()),
)
tree = st.recursive(leaf, lambda x: st.one_of(st.builds(Not, x), st.builds(lambda a: And(tuple(a)), st.lists(x, min_size=1, max_size=3)), st.builds(lambda a: Or(tuple(a)), st.lists(x, min_size=1, max_size=3))), max_leaves=8)


def holds(p, row):
    if isinstance(p, Cmp):
        a, b = row[p.column], p.value
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[p.op]
    if isinstance(p, In):
        return (row[p.column] in p.values) != p.negated
    if isinstance(p, Const):
        return p.value
    if isinstance(p, Not):
        return not holds(p.part, row)
    return (all if isinstance(p, And) else any)(holds(q, row) for q in p.parts)


@settings(max_examples=400, deadline=None)
@given(tree, st.integers(0, 40), st.integers(-3, 40))
def test_no_matching_row_is_lost(p, u, other):
    row = {"uid": u, "other": other}
    if holds(p, row):
        got = prune(p, ONE)
        assert got is None or ONE.locate(ONE.vshards[0], {"uid": u}) in got
