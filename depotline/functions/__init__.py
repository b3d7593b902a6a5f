from depotline.functions.sequencing import running_agg, running_aggs, dense_number, running_max
from depotline.functions.money import cents, to_money, to_rate, round_cents

__all__ = ["running_agg", "running_aggs", "dense_number", "running_max", "cents", "to_money", "to_rate",
           "round_cents"]
