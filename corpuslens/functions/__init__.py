"""Column functions and the rule tables behind them."""
