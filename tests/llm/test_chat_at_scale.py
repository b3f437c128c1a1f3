"""Quotation linking on ten thousand messages with planted quotes, against its SQL."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tests.compare import differences
from textmill.llm import chat, queries

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def messages(seed, n):
    """Conversations whose messages quote earlier ones: whole texts, paragraphs, lines, quotes of quotes, with other case and blanks, and quotes of nothing."""
    rng = random.Random(seed)
    out, conv = [], 0
    while len(out) < n:
        conv += 1
        said = []
        for turn in range(rng.choice([1, 2, 3, 8, 20, 60])):
            lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 7))).capitalize() + rng.choice([".", "!", ""]) for _ in range(rng.randint(1, 4))]
            own = rng.choice(["\n", "\n\n"]).join(lines)
            parts = [own]
            if said and rng.random() < 0.7:
                source = rng.choice(said)
                quoted = rng.choice([source, source.split("\n")[0], source.split("\n\n")[0], "words that nobody has said"])
                quoted = rng.choice([quoted, quoted.upper(), quoted.replace(" ", "  ")])
                mark = rng.choice(["> ", ">", " > "])
                block = "\n".join(mark + x for x in quoted.split("\n"))
                parts.insert(rng.choice([0, 0, 1]), rng.choice(["On Monday they wrote:\n", "", ""]) + block)
            text = "\n".join(parts)
            out.append((conv, turn if rng.random() > 0.01 else None, rng.choice(["user", "assistant"]), text if rng.random() > 0.01 else None))
            said.append(text)
    return out


def test_planted_quotes(spark, tmp_path):
    rows = messages(6, 10_000)
    pq.write_table(pa.table({n: list(c) for n, c in zip(("conv_id", "turn", "role", "text"), zip(*rows))}), tmp_path / "conversations.parquet", row_group_size=2000)
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet'")
    assert differences(spark, str(tmp_path), queries.op2_quotation_linking, chat.SQL, duck) == []
    made = queries.op2_quotation_linking(spark, str(tmp_path)).selectExpr("sum(n_linked)", "max(depth)", "count_if(parent_turn is not null)", "max(max_level)").first()
    assert made[0] > 2000 and made[1] > 5 and made[2] > 1500 and made[3] > 1
