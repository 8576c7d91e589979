"""factloom: structural analytics over nested fact tables, graphs and text, on Spark DataFrames."""
