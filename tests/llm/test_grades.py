"""Held-out agreement of toxicity grades: fitted on even doc_ids, judged on odd ones."""

import numpy as np
import pyarrow.parquet as pq

from spindrift.llm import toxicity


def held_out(folder):
    """Made grade and predicted grade of each odd labelled row; made grades are those of a fit on all rows."""
    texts = dict(zip(*(pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).column(i).to_pylist() for i in (0, 1))))
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    rows = sorted((r["doc_id"], int(r["toxic"])) for r in labels if r["toxic"] is not None and r["doc_id"] in texts)
    bags = [np.frombuffer(toxicity._bag(texts[i] or ""), np.uint32) for i, _ in rows]
    toxic = np.array([y == 1 for _, y in rows])
    severe = toxicity.severities(bags, toxic)[toxic]
    made = np.zeros(len(rows), int)
    made[toxic] = 1 + np.searchsorted(np.sort(severe), severe) * (toxicity.GRADES - 1) // toxic.sum()
    even = [k for k, (i, _) in enumerate(rows) if i % 2 == 0]
    model = toxicity.fit(sorted(((bags[k].tobytes(), int(toxic[k])) for k in even), key=lambda r: (r[1], r[0])))
    scorer = toxicity.Scorer(model)
    odd = [k for k, (i, _) in enumerate(rows) if i % 2]
    p = model.at_least(np.array([scorer.linear(texts[rows[k][0]] or "") for k in odd]))
    return made[odd], (p >= 0.5).sum(axis=1), p.sum(axis=1)


def test_grades_agree_on_rows_that_were_held_out():
    made, said, expected = held_out("/root/testdata/sf0.1")
    table = np.array([[((made == a) & (said == b)).sum() for b in range(toxicity.GRADES)] for a in range(toxicity.GRADES)])
    print(table)
    assert (said[made == 0] == 0).mean() >= 0.99
    assert (said[made > 0] > 0).mean() >= 0.8
    assert (abs(said - made) <= 1).mean() >= 0.95 and (said[made == 3] >= 2).mean() >= 0.9
    means = [expected[made == g].mean() for g in range(toxicity.GRADES)]
    assert means == sorted(means) and means[0] < 0.2
