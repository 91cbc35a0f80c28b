"""Fixed values of the domain: which years train, how long a label matures, how rates are smoothed."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    train_years: tuple[int, ...] = (2022, 2023, 2024)
    validation_year: int = 2025
    test_year: int = 2026
    birth_years: tuple[int, ...] = tuple(range(2012, 2022))
    maturity_days: int = 60
    windows: tuple[int, ...] = (90, 365)
    prior_rolling: float = 20.0
    prior_agency: float = 50.0
    folds: int = 5
    queue_fraction: float = 0.10
    absent: int = -1


#: The same roles on the driver's tables: ship years stand for request years.
DEMO = Config(train_years=(1995, 1996, 1997, 1998), validation_year=1999, test_year=2000)

#: Status of a request that is on its way to another agency; it is no finished case.
IN_TRANSIT = "Encaminhada por Outro Órgão"

#: Words that mean null, besides the empty string and one space.
NULL_WORDS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: The states of each region.
REGIONS = {
    "N": ("AC", "AP", "AM", "PA", "RO", "RR", "TO"),
    "NE": ("AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"),
    "CO": ("DF", "GO", "MT", "MS"),
    "SE": ("ES", "MG", "RJ", "SP"),
    "S": ("PR", "RS", "SC"),
}

#: Inputs that are only known after the decision and must not reach scoring.
FORBIDDEN_INPUTS = (
    "Situacao", "FoiProrrogado", "FoiReencaminhado", "DataResposta", "Decisao",
    "EspecificacaoDecisao", "DetalhamentoDecisao", "MotivoNegativaAcesso",
    "PrazoRestricaoAcesso", "AssuntoPedido", "SubAssuntoPedido", "Tag",
    "PrazoAtendimento", "prazo_dias", "ProtocoloPedido", "protocolo_seq",
)

#: The inputs of the shipped model, in its order; the first fourteen are categories.
MODEL_INPUTS = (
    "Esfera", "UF", "Municipio", "OrgaoDestinatario", "FormaResposta", "OrigemSolicitacao", "TipoDemandante",
    "Genero", "Escolaridade", "Profissao", "TipoPessoaJuridica", "Pais", "UF_sol", "Municipio_sol",
    "reg_month", "reg_dow", "reg_day", "idade", "orgao_rate", "uf_match", "n_pedidos_previos",
    "prev_reenc_solicitante", "prev_reenc_rate_solicitante", "n_pedidos_previos_neste_orgao",
    "prev_reenc_neste_orgao", "n_orgaos_distintos_previos", "dias_desde_ultimo_pedido",
    "prev_reenc_rate_neste_orgao", "orgao_rate_movel_90d", "orgao_rate_movel_365d",
    "dias_desde_primeiro_pedido_do_orgao",
)
