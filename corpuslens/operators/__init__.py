"""Jobs over tables of many repositories; every join begins with repo_id or vault_id."""
